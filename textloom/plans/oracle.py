"""DuckDB SQL of analysis, inversion and search, to hold the DataFrame plans against."""

from __future__ import annotations

from textloom.functions.analysis import SQL_TOKEN, STOP_WORDS
from textloom.functions.norms import sql_length_value

_TOKEN = SQL_TOKEN.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def raw(table: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTEs l(doc_id, l) and raw(doc_id, t, pos)."""
    return (
        f"l as (select {doc_id} as doc_id, list_filter(regexp_extract_all(coalesce({text}, ''), '{_TOKEN}'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as l from {table}), "
        "raw as (select doc_id, unnest(l) as t, cast(unnest(range(len(l))) as integer) as pos from l)"
    )


def tokens(table: str = "documents", doc_id: str = "doc_id", text: str = "text", stop: bool = True) -> str:
    """CTE k(doc_id, term, pos) after the filters."""
    keep = f" and lower(t) not in ({_STOP})" if stop else ""
    return f"{raw(table, doc_id, text)}, k as materialized (select doc_id, lower(t) as term, pos from raw where length(lower(t)) <= 255{keep})"


def inverted(table: str = "documents", doc_id: str = "doc_id", text: str = "text", stop: bool = True) -> str:
    """CTEs dl, norms, post and n."""
    return (
        f"{tokens(table, doc_id, text, stop)}, dl as (select doc_id, count(*) as length from k group by doc_id), norms as (select doc_id, length, {sql_length_value('length')} as norm from dl), "
        "post as materialized (select doc_id, term, cast(count(*) as integer) as freq, list(pos order by pos) as positions from k group by doc_id, term), "
        f"n as (select count(*) as maxdoc from {table} where {doc_id} is not null)"
    )


def term(text: str, boost: float = 1.0, doc_freq: int | None = None) -> dict:
    return {"term": text, "boost": boost, "df": doc_freq}


def pattern(condition: str, boost: float = 1.0) -> dict:
    return {"where": condition, "boost": boost}


def phrase(*terms: str, boost: float = 1.0) -> dict:
    return {"phrase": terms, "boost": boost}


def boolean(*clauses: tuple[str, dict], boost: float = 1.0, coord: bool = True, min_should: int = 0) -> dict:
    return {"clauses": clauses, "boost": boost, "coord": coord, "min": min_should}


def _f(x: str) -> str:
    return f"cast({x} as float)"


def hits(node: dict, table: str = "documents", doc_id: str = "doc_id", text: str = "text", stop: bool = True) -> str:
    """``with ...`` up to a CTE hits(doc_id, score)."""
    leaves: list[dict] = []

    def gather(x):
        if "clauses" in x:
            for _, c in x["clauses"]:
                gather(c)
        else:
            x["i"] = len(leaves)
            leaves.append(x)

    gather(node)
    idf = lambda t: _f(f"{_f(f'ln(cast(maxdoc as double) / ((select count(*) from post where term = {quoted(t)}) + 1))')} + {_f('1.0')}")
    columns = []
    for x in leaves:
        if "term" in x:
            own = idf(x["term"]) if x["df"] is None else _f(f"{_f(f'ln(cast(maxdoc as double) / {x["df"] + 1})')} + {_f('1.0')}")
        elif "phrase" in x:
            own = _f("0")
            for t in x["phrase"]:
                own = _f(f"{own} + {idf(t)}")
        else:
            own = _f("1.0")
        columns.append(f"{own} as idf{x['i']}")

    def weight(x):
        return _f(f"idf{x['i']} * {_f(x['boost'])}")

    def squares(x):
        if "clauses" not in x:
            return _f(f"{weight(x)} * {weight(x)}")
        out = _f("0")
        for o, c in x["clauses"]:
            if o != "-":
                out = _f(f"{out} + {squares(c)}")
        return _f(f"{out} * {_f(f'{_f(x["boost"])} * {_f(x["boost"])}')}")

    values = []

    def down(x, top):
        if "clauses" in x:
            for _, c in x["clauses"]:
                down(c, _f(f"{top} * {_f(x['boost'])}"))
        else:
            w = _f(f"{weight(x)} * {_f(f'qn * {top}')}")
            values.append(f"{_f(f'{w} * idf{x["i"]}')} as v{x['i']}")

    down(node, _f("1.0"))

    def scored(x) -> str:
        if "term" in x:
            return f"select doc_id, {_f(f'{_f(f"{_f("sqrt(cast(freq as double))")} * v{x["i"]}")} * norm')} as score from post join norms using (doc_id), v where term = {quoted(x['term'])}"
        if "where" in x:
            return f"select distinct doc_id, v{x['i']} as score from post, v where {x['where']}"
        if "phrase" in x:
            joined = " ".join(f"join k as k{j} on k{j}.doc_id = k0.doc_id and k{j}.pos = k0.pos + {j} and k{j}.term = {quoted(t)}" for j, t in enumerate(x["phrase"]) if j)
            own = f"select k0.doc_id, count(*) as freq from k as k0 {joined} where k0.term = {quoted(x['phrase'][0])} group by k0.doc_id"
            return f"select doc_id, {_f(f'{_f(f"{_f("sqrt(cast(freq as double))")} * v{x["i"]}")} * norm')} as score from ({own}) join norms using (doc_id), v"
        parts = " union all ".join(f"select doc_id, {quoted(o)} as occur, score from ({scored(c)})" for o, c in x["clauses"])
        most = sum(o != "-" for o, _ in x["clauses"])
        coord = _f(f"{_f('overlap')} / {_f(most)}") if x["coord"] and most > 1 else _f("1.0")
        must = sum(o == "+" for o, _ in x["clauses"])
        return (
            f"select doc_id, {_f(f's * cast({coord} as double)')} as score from (select doc_id, sum(case when occur <> '-' then cast(score as double) end) as s, count(case when occur <> '-' then 1 end) as overlap, "
            f"count(case when occur = '+' then 1 end) as required, count(case when occur = '-' then 1 end) as prohibited from ({parts}) group by doc_id) "
            f"where prohibited = 0 and overlap > 0 and required = {must} and overlap - required >= {x['min']}"
        )

    return (
        f"with {inverted(table, doc_id, text, stop)}, u as materialized (select {', '.join(columns)} from n), q as materialized (select *, {_f(f'1.0 / sqrt(cast({squares(node)} as double))')} as qn from u), "
        f"v as materialized (select {', '.join(values)} from q), hits as ({scored(node)})"
    )


def best(node: dict, k: int = 10, **table) -> str:
    return f"{hits(node, **table)} select doc_id, score from hits order by score desc, doc_id limit {k}"
