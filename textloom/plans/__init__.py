"""Query trees, their parser, field options and similarities: everything decided before a job runs."""
