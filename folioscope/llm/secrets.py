"""Secret scans with corpus-wide ownership frequency, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

# Fixed values of the scan: kinds in their order, pattern, group that holds the value, its least length.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("bare", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
]
#: For marking matches.  Hex runs are whole runs, so the shorter ones need no mark.
_MARKED = {"hex": r"[0-9a-f]{24,}"}
_MARK = "\x01"
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _pieces(text: Column, rank: int) -> Column:
    """The text cut before and after each match of one kind, leftmost and without overlap: every
    second piece is a match.

    The mark, if the text has it, is replaced beforehand by another control character, which no
    pattern knows either.
    """
    kind, pattern, *_ = KINDS[rank]
    marked = F.regexp_replace(F.translate(text, _MARK, "\x02"), _MARKED.get(kind, pattern), f"{_MARK}$0{_MARK}")
    return F.split(marked, _MARK)


def running(values: Column, combine, none: Column) -> Column:
    """For each place of an array what `combine` makes of the values up to it, from lists shifted by 1, 2,
    4 ... places: a fold that appends would copy its list for every place."""
    steps = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(values)))), lambda k: F.pow(F.lit(2), k).cast("int"))

    def doubled(done: Column, step: Column) -> Column:
        n = F.size(done)
        return F.zip_with(F.concat(F.array_repeat(none, F.least(step, n)), F.slice(done, 1, F.greatest(n - step, F.lit(0)))), done, combine)

    return F.aggregate(steps, values, doubled)


def _spans(pieces: Column, ends: Column, rank: int) -> Column:
    """The matches among pieces, whose ends are given, as an array of spans in code points."""
    kind, pattern, group, least = KINDS[rank]

    def span(piece: Column, k: Column) -> Column:
        value = F.regexp_extract(piece, pattern, group) if group else piece
        end = F.get(ends, k)
        return F.struct((end - F.length(piece)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.when(k % 2 == 1, value).alias("value"))

    return F.filter(F.transform(pieces, span), lambda s: F.length(s["value"]) >= least)


def _apart(bare: Column, base: Column) -> Column:
    """The spans of `bare` that meet none of `base`.

    All of them in order of their starts: a span meets one of base if one that begins no later
    ends behind its start, or the next one begins before its end.
    """
    most = F.lit(2**31 - 1)
    tagged = lambda spans, is_base: F.transform(spans, lambda s: F.struct(s["start"].alias("at"), (~is_base).alias("bare"), s.alias("span")))
    every = F.array_sort(F.concat(tagged(base, F.lit(True)), tagged(bare, F.lit(False))))
    behind = running(F.transform(every, lambda e: F.when(e["bare"], F.lit(-1)).otherwise(e["span"]["end"])), lambda x, y: F.greatest(x, y), F.lit(-1))
    starts = F.transform(F.reverse(every), lambda e: F.when(e["bare"], most).otherwise(e["at"]))
    ahead = F.reverse(running(starts, lambda x, y: F.least(x, y), most))
    judged = F.zip_with(F.zip_with(every, behind, lambda e, x: F.struct(e.alias("e"), x.alias("behind"))), ahead, lambda e, x: F.struct(e["e"].alias("e"), e["behind"].alias("behind"), x.alias("ahead")))
    free = F.filter(judged, lambda j: j["e"]["bare"] & (j["behind"] <= j["e"]["at"]) & (j["ahead"] >= j["e"]["span"]["end"]))
    return F.transform(free, lambda j: j["e"]["span"])


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def ownership(found: DataFrame) -> DataFrame:
    """found(value, owner, repo) -> value, owners, repos: how many different ones hold each value.

    Counted in steps, each with a map-side combine, so a value that all rows hold is a few rows a
    task.
    """
    pairs = found.select("value", "owner", "repo").distinct()
    by_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    most_owners: int = 2,
    most_repos: int | None = None,
) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_bare, n_live, n_example, n_owners, n_repos.

    The kinds assign, access and hex are found by pattern in the whole text (null: empty).  The
    corpus adds spans of kind bare: runs of 20 or more characters with a letter and a digit, apart
    from the base spans, whose value no more than `most_owners` owners (and `most_repos`
    repositories, if given) hold.  n_live counts the spans whose value is held so narrowly,
    n_example those whose value is widely copied; base spans stay in either case.  Without
    repo_col equal texts are one repository, so a group of copies counts once; a null owner or
    repository counts as one owner or repository.  n_owners and n_repos say how many owners and
    repositories hold the row's most widely held value (0: it has none).  spans are kind:start:end, by start and then
    kind, in code points, end exclusive.  Values leave no task: only their digests are compared.
    The work grows with a text's length, but for a factor of the logarithm of its spans.
    """
    text = text_or_empty(text_col)
    hashed = lambda s: s.withField("value", F.sha2(s["value"].cast("binary"), 256))
    own = F.coalesce(F.col(repo_col).cast("string"), F.lit("\x01null")) if repo_col else F.concat_ws("-", F.xxhash64(text), F.crc32(text.cast("binary")))
    every = range(len(KINDS))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x01null")).alias("owner"),
        own.alias("repo"),
        *[_pieces(text, k).alias(f"pieces{k}") for k in every],
    )
    some = lambda k: F.size(f"pieces{k}") > 1
    add = lambda a, b: a + b
    rows = rows.withColumns({f"ends{k}": F.when(some(k), running(F.transform(f"pieces{k}", F.length), add, F.lit(0))) for k in every})
    none = F.array().cast(f"array<{SPAN}>")
    spans = [F.when(some(k), _spans(F.col(f"pieces{k}"), F.col(f"ends{k}"), k)).otherwise(none) for k in every]
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    rows = rows.select("row", "id", "owner", "repo", F.array_sort(F.concat(*spans[:3])).alias("base"), F.filter(spans[3], mixed).alias("bare"))
    meet = (F.size("base") > 0) & (F.size("bare") > 0)
    rows = rows.withColumn("bare", F.when(meet, _apart(F.col("bare"), F.col("base"))).otherwise(F.col("bare")))
    rows = rows.withColumns({c: F.transform(c, hashed) for c in ("base", "bare")})
    rows = staged(rows, "secret-rows")
    found = rows.select("row", "owner", "repo", F.explode(F.concat("base", "bare")).alias("span"))
    found = found.select("row", "owner", "repo", "span", F.col("span.value").alias("value"))
    held = staged(ownership(found), "secret-owners")
    verdict = found.join(held, "value").withColumn(
        "live", (F.col("owners") <= most_owners) & (F.lit(True) if most_repos is None else F.col("repos") <= most_repos)
    )
    bare = F.col("span.kind") == "bare"
    by_row = verdict.groupBy("row").agg(
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live") & ~bare).alias("n_example"),
        F.collect_list(F.when(bare & F.col("live"), F.col("span"))).alias("added"),
        F.max("owners").alias("n_owners"),
        F.max("repos").alias("n_repos"),
    )
    wide = rows.join(by_row, "row", "left").withColumn("added", F.coalesce("added", none))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return wide.select(
        F.col("id").alias(id_col),
        *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS[:3]],
        F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_bare"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_owners", "n_repos")],
    )
