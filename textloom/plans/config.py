"""Options of fields and how they merge when a field is indexed more than once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

DOCS, FREQS, POSITIONS, OFFSETS = 1, 2, 3, 4


@dataclass(frozen=True)
class FieldOptions:
    """What is kept of a field. options: DOCS to OFFSETS; many: the column is an array of values."""

    indexed: bool = True
    stored: bool = False
    tokenized: bool = True
    omit_norms: bool = False
    options: int = POSITIONS
    many: bool = False
    kind: str | None = None

    def __post_init__(self):
        if not DOCS <= self.options <= OFFSETS:
            raise ValueError(f"options must be {DOCS} to {OFFSETS}")

    def merge(self, other: FieldOptions) -> FieldOptions:
        """Indexed once is indexed always, norms omitted once are omitted always, options go down to the least. A use that isn't indexed changes none of these."""
        if self.kind and other.kind and self.kind != other.kind:
            raise ValueError(f"a field's kind can't change from {self.kind} to {other.kind}")
        stored, kind = self.stored or other.stored, self.kind or other.kind
        if not other.indexed or not self.indexed:
            base = self if self.indexed else other
            return replace(base, stored=stored, kind=kind)
        return replace(self, stored=stored, kind=kind, omit_norms=self.omit_norms or other.omit_norms, options=min(self.options, other.options), many=self.many or other.many)


TEXT = FieldOptions()
KEYWORD = FieldOptions(tokenized=False, omit_norms=True, options=DOCS)
STORED = FieldOptions(indexed=False, stored=True)


@dataclass
class IndexConfig:
    """Fields by name, numbered in the order in which they are first seen."""

    fields: dict[str, FieldOptions] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)

    def add(self, name: str, options: FieldOptions, number: int | None = None) -> int:
        self.fields[name] = self.fields[name].merge(options) if name in self.fields else options
        if name not in self.numbers:
            taken = set(self.numbers.values())
            free = next(k for k in range(len(taken) + 1) if k not in taken)
            self.numbers[name] = number if number is not None and number not in taken else free
        return self.numbers[name]
