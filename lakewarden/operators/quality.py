"""Completeness, uniqueness, validity and consistency of a table, and the rows at fault."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lakewarden import config
from lakewarden.functions import rows as whole
from lakewarden.functions.columns import as_text, as_timestamp, normalised_column, whole_match
from lakewarden.operators.findings import Finding
from lakewarden.operators.profiling import profiled_fields
from lakewarden.operators.typing import Typed
from lakewarden.sources.tables import ROW, column

CELL = "issue_type string, column string, kind string, row_id long"


@dataclass
class Dimension:
    dimension: str
    score: float | None
    threshold: float | None
    failing: list[str] = field(default_factory=list)
    evidence: dict = field(default_factory=dict)
    reason: str | None = None
    findings: list[Finding] = field(default_factory=list)

    @property
    def passed(self) -> bool | None:
        """None where it wasn't assessed."""
        return None if self.score is None else self.score >= self.threshold


def _cell(df: DataFrame, name: str) -> Column:
    return normalised_column(name, df.schema[name].dataType)


def _class_of(types: list[Typed], name: str) -> str:
    return next((t.data_class for t in types if t.name == name), config.NON_PERSONAL)


def worst_class(types: list[Typed]) -> str:
    return max((t.data_class for t in types), key=lambda c: config.CLASS_RANK.get(c, 0), default=config.NON_PERSONAL)


# Completeness


def null_shares(df: DataFrame, names: list[str]) -> DataFrame:
    """column, rows, nulls, null_pct of each named column: one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_cell(df, n)).alias(f"n{i}") for i, n in enumerate(names)])
    nulls = [(F.col("rows") - F.col(f"n{i}")) for i in range(len(names))]
    records = [F.struct(F.lit(n).alias("column"), F.col("rows"), x.alias("nulls"), F.when(F.col("rows") > 0, F.bround(x * 100.0 / F.col("rows"), 2)).alias("null_pct")) for n, x in zip(names, nulls)]
    return row.select(F.inline(F.array(*records)))


def completeness_score(shares: DataFrame) -> DataFrame:
    """One row: the share of filled cells, of 100."""
    return shares.agg(F.bround((1 - F.sum("nulls") / F.sum("rows").cast("double")) * 100, 2).alias("score"))


def completeness(df: DataFrame, types: list[Typed], required: list[str] | None, shares: list[Row] | None = None) -> Dimension:
    """shares: rows of name, rows, null_count and null_pct, if `basics` has run already."""
    fields = {f.name for f in profiled_fields(df)}
    names = [n for n in (df.columns if required is None else required) if n in fields]
    limit = config.THRESHOLDS["completeness"]
    if not names:
        return Dimension("completeness", None, limit, reason="no required columns present")
    if shares is None:
        rows = [r.asDict() for r in null_shares(df, names).collect()]
    else:
        by = {r["name"]: {"column": r["name"], "rows": r["rows"], "nulls": r["null_count"], "null_pct": r["null_pct"]} for r in shares}
        rows = [by[n] for n in names]
    total = rows[0]["rows"]
    out = Dimension("completeness", round(100 * (1 - sum(r["nulls"] for r in rows) / (total * len(rows))), 2), limit, evidence={"null_pct_by_column": {r["column"]: r["null_pct"] for r in rows}, "columns_assessed": len(rows)})
    for r in rows:
        if r["null_pct"] > config.NULL_HEAVY_PCT:
            out.failing.append(r["column"])
            out.findings.append(Finding("quality", "null_heavy_column", r["column"], config.DESCRIPTIONS["null_heavy_column"].format(pct=r["null_pct"], column=r["column"]), _class_of(types, r["column"]), total, scope="column", evidence={"null_pct": r["null_pct"], "threshold": config.NULL_HEAVY_PCT}, articles=tuple(config.ISSUE_ARTICLES["null_heavy_column"])))
    return out


# Uniqueness


def _nested(df: DataFrame, key: list[str]) -> bool:
    return any(whole.is_nested(df.schema[k].dataType) for k in key)


def repeated_rows(df: DataFrame, key: list[str], order: str = ROW) -> DataFrame:
    """Rows that repeat an earlier row's key (nulls are equal); cells aren't normalised first.

    A key with nested columns is compared by digests, confirmed on canonical values. Of any other the first row of each key comes from an aggregate that is combined before the shuffle, so that a key of a third of the rows is no hot task; rows are then compared with it."""
    if _nested(df, key):
        return whole.later(df, key, order)
    named = [column(k).alias(f"__k{i}") for i, k in enumerate(key)]
    firsts = df.select(*named, F.col(order).alias("__o")).groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.min("__o").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    on = [column(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    return df.join(firsts, on).where(F.col(order) > F.col("__first")).select(*[column(c) for c in df.columns])


def all_copies(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, the first included."""
    if _nested(df, key):
        return whole.shared(df, key)
    named = [column(k).alias(f"__k{i}") for i, k in enumerate(key)]
    shared = df.select(*named).groupBy(*[f"__k{i}" for i in range(len(key))]).count().where("count > 1").drop("count")
    on = [column(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    return df.join(shared, on, "left_semi")


def uniqueness(df: DataFrame, types: list[Typed], key: list[str] | None, total: int) -> tuple[Dimension, DataFrame | None]:
    """Without a key, whole rows are compared: all columns but the row number, nested ones included."""
    by_row, fields = key is None, whole.whole_row(df)
    key = [k for k in (fields if by_row else key) if k in fields]
    limit = config.THRESHOLDS["uniqueness"]
    if not key:
        return Dimension("uniqueness", None, limit, reason="business key not present"), None
    if by_row or _nested(df, key):
        rows, n = whole.later(df, key), whole.repeats(df, key).first()["n"]
    else:
        rows = repeated_rows(df, key)
        n = df.groupBy(*[column(k) for k in key]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    label = " + ".join(key)
    rows = rows.select(F.lit("duplicate_record").alias("issue_type"), F.lit(label).alias("column"), F.lit("").alias("kind"), F.col(ROW).alias("row_id"))
    out = Dimension("uniqueness", round(100 * (1 - n / max(total, 1)), 2), limit, key if n else [], {"business_key": key, "duplicate_count": n})
    if n:
        description = config.DESCRIPTIONS["duplicate_record"].format(n=n, key=label)
        evidence = {"business_key": key, "duplicate_count": n}
        found = Finding("quality", "duplicate_record", label, description, worst_class(types), total, n, evidence=evidence, articles=tuple(config.ISSUE_ARTICLES["duplicate_record"]))
        out.findings.append(found)
    return out, rows


# Validity


def invalid_cells(df: DataFrame, kinds: dict[str, str], row: str = ROW) -> DataFrame:
    """issue_type, column, kind, row_id of non-null cells that aren't of their column's pattern as a whole."""
    records = []
    for name, kind in kinds.items():
        text = as_text(_cell(df, name), df.schema[name].dataType)
        issue = f"invalid_{kind}" if f"invalid_{kind}" in config.SEVERITY else "invalid_format"
        records.append(F.struct(F.lit(issue).alias("issue_type"), F.lit(name).alias("column"), F.lit(kind).alias("kind"), (~whole_match(text, config.PATTERNS[kind])).alias("bad")))
    return df.select(F.inline(F.array(*records)), F.col(row).cast("long").alias("row_id")).where("bad").drop("bad")


def validity_rates(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """column, kind, checked, valid."""
    cells = {n: as_text(_cell(df, n), df.schema[n].dataType) for n in kinds}
    row = df.agg(*[x for i, (n, k) in enumerate(kinds.items()) for x in (F.count(cells[n]).alias(f"c{i}"), F.count_if(whole_match(cells[n], config.PATTERNS[k])).alias(f"v{i}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("checked"), F.col(f"v{i}").alias("valid")) for i, (n, k) in enumerate(kinds.items())])))


def validity(df: DataFrame, types: list[Typed], total: int) -> tuple[Dimension, DataFrame | None]:
    kinds = {t.name: t.semantic_type for t in types if t.semantic_type in config.PATTERNS}
    limit = config.THRESHOLDS["validity"]
    rates = [{"column": t.name, "kind": t.semantic_type, "checked": t.filled, "valid": round(t.rate * t.filled)} for t in types if t.name in kinds and t.filled]
    if not rates:
        return Dimension("validity", None, limit, reason="no column has a pattern to check"), None
    checked, valid = sum(r["checked"] for r in rates), sum(r["valid"] for r in rates)
    out = Dimension("validity", round(100 * valid / checked, 2), limit, evidence={"checked": checked, "valid": valid})
    for r in rates:
        bad = r["checked"] - r["valid"]
        if 100 * r["valid"] / r["checked"] < limit:
            out.failing.append(r["column"])
        if bad:
            issue = f"invalid_{r['kind']}" if f"invalid_{r['kind']}" in config.SEVERITY else "invalid_format"
            out.findings.append(Finding("quality", issue, r["column"], config.DESCRIPTIONS["invalid_format"].format(n=bad, column=r["column"], kind=r["kind"].replace("_", " ")), _class_of(types, r["column"]), total, bad, evidence={"expected_type": r["kind"], "conformance_pct": round(100 * r["valid"] / r["checked"], 2)}, kind=r["kind"]))
    return out, invalid_cells(df, kinds)


# Consistency


def odd_spellings(df: DataFrame, name: str, mapping: dict[str, str], row: str = ROW) -> DataFrame:
    """row_id, value, canon, odd of cells that the mapping knows; odd ones aren't the commonest spelling of their value.

    Of equally common spellings the one that occurs first counts. There are as many spellings as the mapping has, so the second aggregate is small."""
    pairs = df.sparkSession.createDataFrame(list(mapping.items()), "surface string, canon string")
    known = df.select(F.col(row).cast("long").alias("row_id"), _cell(df, name).cast("string").alias("value")).join(F.broadcast(pairs), F.col("value") == F.col("surface")).drop("surface")
    counts = known.groupBy("canon", "value").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    common = counts.groupBy("canon").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("common"))
    return known.join(F.broadcast(common), "canon").select("row_id", "value", "canon", (F.col("value") != F.col("common")).alias("odd"))


def rule_results(df: DataFrame, names: list[str], expression: str, dates: set[str] = frozenset(), row: str = ROW) -> DataFrame:
    """row_id, ok of rows in which all named columns are filled."""
    cells = {n: (as_timestamp(_cell(df, n), df.schema[n].dataType) if n in dates else _cell(df, n)).alias(n) for n in names}
    filled = df.select(F.col(row).cast("long").alias("row_id"), *cells.values())
    return filled.where(" and ".join(f"`{n}` is not null" for n in names)).select("row_id", F.expr(expression).cast("boolean").alias("ok"))


def check_counts(df: DataFrame, spellings: dict[str, dict[str, str]], rules: list, dates: set[str] = frozenset(), row: str = ROW) -> tuple[list[Row], dict[str, str]]:
    """Counts of all checks by one job, however many there are: rows of (check, value, ok, n, first); and the rules that can't be evaluated, with the reason.

    A check is the name of a column (value: a spelling of it that its mapping knows) or of a rule (ok: of rows in which all its columns are filled). There are as many
    rows as spellings, and two a rule."""
    used = {n for _, names, _ in rules for n in names}
    cells = [(as_timestamp(_cell(df, n), df.schema[n].dataType) if n in dates else _cell(df, n)).alias(n) for n in used]
    texts = {n: f"__text{i}" for i, n in enumerate(spellings)}
    frame = df.select(F.col(row).cast("long").alias("__row"), *cells, *[_cell(df, n).cast("string").alias(t) for n, t in texts.items()])
    records, broken = [], {}

    def checked(name: str, applies: Column, value: Column, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), applies.alias("applies"), value.cast("string").alias("value"), ok.alias("ok"))

    for name, mapping in spellings.items():
        records.append(checked(name, F.col(texts[name]).isin(list(mapping)), F.col(texts[name]), F.lit(None).cast("boolean")))
    for rule, names, expression in rules:
        ok = F.coalesce(F.expr(expression).cast("boolean"), F.lit(False))
        try:
            frame.select(ok)
        except AnalysisException as e:
            broken[rule] = str(e).splitlines()[0]
            continue
        filled = reduce(lambda x, y: x & y, [column(n).isNotNull() for n in names])
        records.append(checked(rule, filled, F.lit(None), F.when(filled, ok)))
    if not records:
        return [], broken
    long = frame.select("__row", F.inline(F.array(*records))).where("applies")
    return long.groupBy("check", "value", "ok").agg(F.count("*").alias("n"), F.min("__row").alias("first")).collect(), broken


def _spelling(df: DataFrame, types: list[Typed], name: str, mapping: dict[str, str], counts: list[Row], total: int) -> tuple[float, Finding | None, DataFrame | None]:
    """Agreement of a column's spellings, and what disagrees. Of equally common spellings the one that occurs first counts."""
    common: dict[str, Row] = {}
    for r in counts:
        canon = mapping[r["value"]]
        if canon not in common or (r["n"], -r["first"]) > (common[canon]["n"], -common[canon]["first"]):
            common[canon] = r
    odd = sum(r["n"] for r in counts if r is not common[mapping[r["value"]]])
    agreement = 1 - odd / sum(r["n"] for r in counts)
    if not odd:
        return agreement, None, None
    description = config.DESCRIPTIONS["spelling"].format(n=odd, column=name)
    found = Finding("quality", "inconsistent_value", name, description, _class_of(types, name), total, odd, evidence={"agreement_pct": round(100 * agreement, 2)}, kind="spelling")
    wrong = [r["value"] for r in counts if r is not common[mapping[r["value"]]]]
    rows = df.where(_cell(df, name).cast("string").isin(wrong))
    return agreement, found, rows.select(F.lit("inconsistent_value").alias("issue_type"), F.lit(name).alias("column"), F.lit("spelling").alias("kind"), F.col(ROW).cast("long").alias("row_id"))


def consistency(df: DataFrame, types: list[Typed], rules: list, total: int) -> tuple[Dimension, list[DataFrame], list[str]]:
    """The mean of all checks' agreements; the rows at fault; and rules that couldn't be evaluated. One job counts for all checks."""
    agreements, rows = [], []
    out = Dimension("consistency", None, config.THRESHOLDS["consistency"])
    dates = {t.name for t in types if t.semantic_type == "date"}
    spellings = {n: m for n, m in config.CANONICAL.items() if n in df.columns}
    rules = [r for r in rules if set(r[1]) <= set(df.columns)]
    # Checks are told apart by their place, as a rule may be named like a column.
    named = {f"s{i}": n for i, n in enumerate(spellings)}
    counted = [(f"r{i}", names, expression) for i, (_, names, expression) in enumerate(rules)]
    copies = df.withColumns({f"__{k}": column(n) for k, n in named.items()}) if named else df
    counts, failed = check_counts(copies, {f"__{k}": spellings[n] for k, n in named.items()}, counted, dates)
    by: dict[str, list[Row]] = {}
    for r in counts:
        by.setdefault(r["check"], []).append(r)
    for k, name in named.items():
        if f"__{k}" in by:
            agreement, found, odd = _spelling(df, types, name, spellings[name], by[f"__{k}"], total)
            agreements.append(agreement)
            if found:
                out.failing.append(name)
                out.findings.append(found)
                rows.append(odd)
    for (key, _, _), (rule, names, expression) in zip(counted, rules):
        n, good = sum(r["n"] for r in by.get(key, [])), sum(r["n"] for r in by.get(key, []) if r["ok"])
        if not n:
            continue
        agreements.append(good / n)
        if bad := n - good:
            description, evidence = config.DESCRIPTIONS["rule"].format(n=bad, expression=expression), {"rule": rule, "expression": expression, "rows_evaluated": n}
            out.failing.append(names[0])
            out.findings.append(Finding("quality", "inconsistent_value", names[0], description, _class_of(types, names[0]), total, bad, evidence=evidence, kind=rule))
            wrong = rule_results(df, names, expression, dates).where("not coalesce(ok, false)")
            rows.append(wrong.select(F.lit("inconsistent_value").alias("issue_type"), F.lit(names[0]).alias("column"), F.lit(rule).alias("kind"), "row_id"))
    if agreements:
        out.score = round(100 * sum(agreements) / len(agreements), 2)
    else:
        out.reason = "no consistency check applies"
    return out, rows, [f"{rule}: {failed[key]}" for (key, _, _), (rule, _, _) in zip(counted, rules) if key in failed]


def overall(dimensions: list[Dimension]) -> float | None:
    """The weighted mean of assessed dimensions."""
    assessed = [(config.WEIGHTS[d.dimension], d.score) for d in dimensions if d.score is not None and d.dimension in config.WEIGHTS]
    return round(sum(w * s for w, s in assessed) / sum(w for w, _ in assessed), 2) if assessed else None


def unassessed() -> list[Dimension]:
    return [Dimension(d, None, None, reason=why) for d, why in config.UNASSESSED.items()]
