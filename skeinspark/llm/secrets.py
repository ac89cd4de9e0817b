"""Secret scans with corpus-wide ownership frequency, native operations only.

Every text is scanned once for assignments, access keys and hex runs. A match's place comes from cutting the text at the same
pattern: the code points of the gaps and matches before it add up to its start. The hash of each candidate's value is then
counted over all documents by distinct repositories and owners, map-side first, and both counts decide:

- `example`, widely copied: `copied_owners` owners or more, or `copied_repositories` repositories or more, whoever owns them;
- `live`, a credential of its owner: one owner, `live_repositories` repositories at most, and a value that looks live, which is
  16 characters or more, letters and digits mixed, without a placeholder's words;
- `shared`: a value that looks live between these, held by two owners or by more repositories of one.

Other values get no verdict. These spans cover the value alone and are added to the base spans, which all stay. The occurrences
of a value that holds a thousandth of all meet their verdict by broadcast (a thousand values at most).

Defined cases: a null text counts as empty; null owners and repositories count as one unnamed owner and repository; rows of one id
are told apart by a hash of their text; repeated rows get the same spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm.common import join_hot, materialize, read, row_key

#: The kinds in the order in which they are listed, the patterns, and words that mark a placeholder.
KINDS = ("assign", "access", "hex", "live", "example", "shared")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|xxxx|your_"
ASSIGN_HINTS = ("passw", "secret", "token", "api")


def _found(text: Column, kind: str, pattern: str, group: int, least: int, hint: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> of the matches whose group has `least` characters or more."""
    pat = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pat, F.lit(0)).alias("all"), F.regexp_extract_all(text, pat, F.lit(group)).alias("value")
    )
    spans = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["all"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        spans = F.when(F.char_length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("bigint").alias("at"), spans.alias("spans"))

    return F.when(hint & F.regexp_like(text, pat), F.aggregate(parts, zero, step, lambda acc: acc["spans"])).otherwise(F.array().cast(spans))


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    hint = F.lit(False)
    for word in ASSIGN_HINTS:
        hint = hint | F.contains(low, F.lit(word))
    return F.sort_array(F.concat(
        _found(text, "assign", ASSIGN, 2, 6, hint), _found(text, "access", ACCESS, 0, 20, F.contains(text, F.lit("AKIA"))), _found(text, "hex", HEX, 0, 24, F.lit(True)),
    ))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def ownership(candidates: DataFrame, copied_owners: int = 3, copied_repositories: int = 5, live_repositories: int = 2) -> DataFrame:
    """h, rows, owners, repositories, verdict (live, example, shared or null) of every distinct value."""
    live = F.max("looks_live").alias("looks_live")
    by_place = candidates.groupBy("h", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"), live)
    by_owner = by_place.groupBy("h", "owner").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("repositories"), live)
    by_hash = by_owner.groupBy("h").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), live)
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    own = (F.col("owners") == 1) & (F.col("repositories") <= live_repositories)
    verdict = F.when(copied, "example").when(F.col("looks_live"), F.when(own, "live").otherwise("shared"))
    return by_hash.select("h", "rows", "owners", "repositories", verdict.alias("verdict"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, **limits: int) -> DataFrame:
    """doc_id, rk, base, spans (arrays of start, rank, end, kind, value): one row per row of docs; the default owner is `source`, its repositories its languages. limits: those of ownership()."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), row_key(text).alias("rk"), base_spans(text).alias("base"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
    ))
    each = rows.filter(F.size("base") > 0).select("doc_id", "rk", "owner", "repository", F.explode("base").alias("s"))
    value = F.col("s.value")
    live = (F.char_length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
    each = materialize(each.select("doc_id", "rk", "owner", "repository", F.sha2(value, 256).alias("h"), live.alias("looks_live"), (F.col("s.end") - F.char_length(value)).alias("start"), F.col("s.end").alias("end")))
    verdicts = materialize(ownership(each, **limits).filter("verdict IS NOT NULL").select("h", "rows", "verdict"))
    judged = join_hot(each.select("h", "doc_id", "rk", "start", "end"), verdicts, "h", each.count())
    rank = F.coalesce(*[F.when(F.col("verdict") == kind, F.lit(KINDS.index(kind))) for kind in KINDS[3:]])
    added = judged.groupBy("doc_id", "rk").agg(
        F.collect_set(F.struct("start", rank.alias("rank"), "end", F.col("verdict").alias("kind"), F.lit(None).cast("string").alias("value"))).alias("added")
    ).withColumnsRenamed({"doc_id": "d", "rk": "k"})
    out = rows.select("doc_id", "rk", "base").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k")), "left")
    return out.select("doc_id", "rk", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint) as n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
