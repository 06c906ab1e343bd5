"""Secrets by corpus-wide ownership frequency, in DataFrame operations only.

Patterns find candidates; the value of each is hashed, and the hashes are counted over the whole corpus by
distinct owners and repositories. A value that many owners have is a widely copied example; one that few
have looks live. Candidates of the three base kinds are always reported, with that verdict beside them;
those of looser kinds only if they look live.

Positions are code points. The texts between a pattern's matches and the matches themselves add up to the
positions, so no match is searched for twice. Only candidates are shuffled, never texts (redaction moves
the texts that have candidates). Owners are counted after values are reduced to distinct (value, owner,
repository) on the map side, so a value that a third of all rows hold is one row per task.

Null texts have no candidates; null owners are one owner; ids may be null or repeated (one row out per row
in); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint

MAX_OWNERS, MAX_REPOSITORIES = 2, 4
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
#: kind: (pattern, group of the value, least code points of the value); the first three are the base kinds
KINDS = {
    "assign": (rf"{_KEYWORD}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 27),
    "bearer": (r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 16),
    "url": (r"://[^\s:/@]{1,64}:([^\s:/@]{6,64})@", 1, 6),
    "private_key": (r"-----BEGIN (?:[A-Z]{2,20} )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}", 0, 60),
}
BASE = 3
#: Matches whose positions are added up one by one; sums of blocks give the rest, so that time stays near the number of matches.
BLOCK = 128
#: Spans to mask up to this many go to all executors (some 50 MB); with more, the texts that have candidates are shuffled.
FEW = 200_000
_ANY = "|".join([rf"{_KEYWORD}[\"']?\x20*[:=]", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", "gh[pousr]_[A-Za-z0-9]{36}", "xox[abprs]-", r"eyJ[A-Za-z0-9_-]{8}", r"(?i:bearer)\x20", r"://[^\s:/@]{1,64}:[^\s:/@]{6,64}@", "-----BEGIN"])


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: str, number: int) -> str:
    """SQL: array of (start, kind, end, value_start, value) of one kind in __llm_t, for texts that may have some."""
    pattern, group, least = KINDS[kind]
    p = _quoted(pattern)
    value = f"regexp_extract_all(__llm_t, {p}, {group})" if group else f"regexp_extract_all(__llm_t, {p}, 0)"
    zipped = f"transform(arrays_zip(split(__llm_t, {p}, -1), regexp_extract_all(__llm_t, {p}, 0), {value}), z -> struct(char_length(z['0']) as gap, char_length(z['1']) as size, z['2'] as value))"
    start = "acc.at + x.gap"
    item = f"struct(cast({start} as int) as start, {number} as kind, cast({start} + x.size as int) as end, cast({start} + x.size - char_length(x.value) as int) as value_start, x.value as value)"
    empty = "cast(array() as array<struct<start:int,kind:int,end:int,value_start:int,value:string>>)"
    part = f"slice(zz, b * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, (size(zz) - 1) div {BLOCK})"
    sums = f"transform({blocks}, b -> aggregate({part}, 0, (n, x) -> cast(n + x.gap + coalesce(x.size, 0) as int)))"
    before = "aggregate(slice(ss, 1, cast(b as int)), 0, (n, x) -> n + x)"
    inside = (
        f"aggregate({part}, struct({before} as at, {empty} as found), (acc, x) -> if(x.size is null, acc, "
        f"struct(cast({start} + x.size as int) as at, if(char_length(x.value) >= {least}, array_append(acc.found, {item}), acc.found) as found))).found"
    )
    # arrays of one element give names to the zipped array and to the sums of its blocks, so that each is computed once
    return f"element_at(transform(array({zipped}), zz -> element_at(transform(array({sums}), ss -> flatten(transform({blocks}, b -> {inside}))), 1)), 1)"


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __llm_found: all candidates of a text, by start, then kind."""
    empty = "cast(array() as array<struct<start:int,kind:int,end:int,value_start:int,value:string>>)"
    every = "array_sort(concat(" + ", ".join(_found(k, n) for n, k in enumerate(KINDS)) + "))"
    docs = docs.withColumn("__llm_t", docs[text_col].cast("string"))
    return docs.withColumn("__llm_found", F.expr(f"case when __llm_t rlike {_quoted(_ANY)} then {every} else {empty} end")).drop("__llm_t")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(value_hash, n_owners, n_repositories, is_live) from rows of (value_hash, owner, repository)."""
    each = found.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = each.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    counted = owners.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    return counted.withColumn("is_live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    x = rows.select(*keys, "owner", "repository", F.explode("__llm_found").alias("x"))
    return x.select(*keys, "owner", "repository", F.sha2("x.value", 256).alias("value_hash"), F.col("x.start").alias("start"), F.col("x.kind").alias("kind"), F.col("x.end").alias("end"), F.col("x.value_start").alias("value_start"))


def _owners(docs: DataFrame, owner_col: str, repository_cols: tuple[str, ...]) -> DataFrame:
    name = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-"))
    return docs.withColumns({"owner": name(owner_col), "repository": F.concat_ws("/", *map(name, repository_cols))})


def _spans(found: str, name: str) -> str:
    names = "array(" + ", ".join(map(_quoted, KINDS)) + ")"
    return f"array_join(transform({found}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',') as {name}"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples (verdicts on the base spans)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *(docs[c].alias(f"__llm_{c}") for c in {owner_col, *repository_cols}))
    rows = _owners(rows, f"__llm_{owner_col}", tuple(f"__llm_{c}" for c in repository_cols))
    rows = with_candidates(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", "__llm_found")
    rows = checkpoint(rows)
    every = _exploded(rows, "row")
    verdict = every.join(ownership(every, max_owners, max_repositories), "value_hash")
    base = F.col("kind") < BASE
    told = verdict.groupBy("row").agg(
        F.count_if(base & F.col("is_live")).alias("live"), F.count_if(base & ~F.col("is_live")).alias("examples"),
        F.array_sort(F.collect_list(F.when(base | F.col("is_live"), F.struct("start", "kind", "end")))).alias("told"),
    )
    count = lambda n: f"cast(size(filter(__llm_found, s -> s.kind = {n})) as bigint)"
    base_found = f"filter(__llm_found, s -> s.kind < {BASE})"
    out = rows.selectExpr("row", "doc_id", f"{count(0)} as n_assign", f"{count(1)} as n_access", f"{count(2)} as n_hex", _spans(base_found, "base_spans"))
    out = out.join(told, "row", "left")
    return out.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "sha2(base_spans, 256) as base_sha256", _spans("coalesce(told, array())", "spans"), "coalesce(live, 0) as n_live", "coalesce(examples, 0) as n_examples")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), mask: str = "[SECRET]", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs with the values of live-looking secrets replaced; widely copied examples stay. n_chars, where present, follows.

    Texts meet their verdicts by a digest of id and text, which null and repeated ids do not disturb. Texts are not shuffled
    unless very many spans are masked.
    """
    owners = {owner_col, *repository_cols}
    key = F.sha2(F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("-")), docs[text_col].cast("string")), 256)
    marked = with_candidates(docs, text_col).where(F.size("__llm_found") > 0).select(key.alias("__llm_key"), "__llm_found", *(docs[c].alias(f"__llm_{c}") for c in owners))
    every = checkpoint(_exploded(_owners(marked, f"__llm_{owner_col}", tuple(f"__llm_{c}" for c in repository_cols)), "__llm_key"))
    live = every.join(ownership(every, max_owners, max_repositories).where("is_live"), "value_hash")
    live = live.groupBy("__llm_key").agg(F.array_sort(F.collect_set(F.struct("value_start", "end"))).alias("__llm_live"))
    live = checkpoint(live)
    spans = live.agg(F.sum(F.size("__llm_live"))).first()[0] or 0
    if spans <= FEW:
        out = docs.withColumn("__llm_key", key).join(F.broadcast(live), "__llm_key", "left")
        return _masked(out, text_col, mask, docs.columns)
    may = F.coalesce(docs[text_col].cast("string").rlike(_ANY), F.lit(False))
    some = docs.where(may).withColumn("__llm_key", key).join(live, "__llm_key", "left")
    return docs.where(~may).unionByName(_masked(some, text_col, mask, docs.columns))


def _masked(docs: DataFrame, text_col: str, mask: str, columns: list[str]) -> DataFrame:
    t = f"cast(`{text_col}` as string)"
    step = f"struct(greatest(acc.at, s.end) as at, if(s.value_start < acc.at, acc.out, concat(acc.out, substring({t}, acc.at + 1, s.value_start - acc.at), {_quoted(mask)})) as out)"
    new = f"aggregate(__llm_live, struct(0 as at, '' as out), (acc, s) -> {step}, acc -> concat(acc.out, substring({t}, acc.at + 1)))"
    kind = dict(docs.dtypes)
    out = docs.withColumn(text_col, F.expr(f"if(__llm_live is null, {t}, {new})"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.expr(f"cast(if(__llm_live is null, n_chars, length(`{text_col}`)) as {kind['n_chars']})"))
    return out.select(*columns)
