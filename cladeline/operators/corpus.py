"""Choosing data sets: hash ranks, strata, manifests and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .report import bin_index, check_edges

# Model names that mean nucleotides, by their beginnings.
NUCLEOTIDE_MODELS = ("JC", "F81", "K80", "K81", "HKY", "TN", "TIM", "TVM", "TPM", "GTR")


def first_by_rank(rows: DataFrame, rank: Column, eligible: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(the k eligible rows of the lowest rank, the rows that were inspected and not eligible).

    Inspected is what has no higher rank than the last one chosen; only k ranks are sorted globally.
    """
    ranked = rows.withColumn("rank", rank).withColumn("eligible", eligible)
    chosen = ranked.where("eligible").orderBy("rank").limit(k)
    last = chosen.agg(F.max("rank").alias("last"), F.count("*").alias("n"))
    excluded = ranked.where("NOT eligible").join(F.broadcast(last), (F.col("n") < k) | (F.col("rank") <= F.col("last")), "inner").drop("last", "n")
    return chosen.drop("eligible"), excluded.drop("eligible")


def stratified(rows: DataFrame, size: Column, edges: Sequence[float], rank: Column, k: int) -> DataFrame:
    """The k lowest ranks of each bin [edge, next edge) of size; rows outside of all bins belong to none.

    Each bin is cut to k within tasks first, so a bin of most of the rows costs no task more than k of each.
    """
    binned = rows.withColumn("bin", bin_index(size, edges)).where("bin IS NOT NULL").withColumn("rank", rank)
    local = W.partitionBy("bin", F.pmod(F.xxhash64("rank"), F.lit(256))).orderBy("rank")
    few = binned.withColumn("place", F.row_number().over(local)).where(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(W.partitionBy("bin").orderBy("rank"))).where(F.col("place") <= k)


def stratified_with_exclusions(rows: DataFrame, size: Column, edges: Sequence[float], rank: Column, k: int, reason: Column) -> tuple[DataFrame, DataFrame, int]:
    """(chosen, excluded, inspected): stratified() over rows looked at in the order of rank until all bins are full.

    ``reason`` is null for a fit row; a row that is not, or lies outside of all bins, is excluded with its reason if it was
    looked at.  What a full bin had no room for is neither chosen nor excluded.
    """
    edges = check_edges(edges, least=2)
    ranked = rows.withColumn("rank", rank).withColumn("size", size)
    outside = F.when(bin_index(F.col("size"), edges).isNull(), F.concat(F.lit("size="), F.col("size").cast("string"), F.lit(f" lies outside [{int(edges[0])}, {int(edges[-1])})")))
    judged = ranked.withColumn("reason", F.coalesce(reason, outside))
    chosen = stratified(judged.where("reason IS NULL"), F.col("size"), edges, F.col("rank"), k)
    ends = chosen.groupBy("bin").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    full, last = ends.where(F.col("n") == k).agg(F.count("*"), F.max("last")).first()
    looked = judged if full < len(edges) - 1 else judged.where(F.col("rank") <= last)
    return chosen.drop("reason", "size"), looked.where("reason IS NOT NULL").select(*rows.columns, "rank", "reason"), looked.count()


def choose_families(families: DataFrame, leaves: str, least: int, most: int, wanted: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Families (family, position, ...) with so many leaves, of the wanted names if any are given, the first ``limit`` of them by position."""
    out = families.where(F.col(leaves).between(least, most))
    if wanted is not None:
        out = out.where(F.col("family").isin(*wanted))
    return out if limit is None else out.orderBy("position").limit(limit)


def lowest(rows: DataFrame, hash_column: str, identifier: str, most: int) -> DataFrame:
    """All rows if there are at most ``most``, else those of the lowest hashes, in the order of the identifier."""
    return rows.orderBy(hash_column, identifier).limit(most).orderBy(identifier)


def coverage_quantiles(rows: DataFrame, value: str, percents: Sequence[int]) -> DataFrame:
    """Nearest-rank quantiles, half-way ranks to the even one; counts by value keep the sort small."""
    counts = rows.groupBy(value).count()
    order = W.partitionBy(F.lit(0)).orderBy(value)
    upto = counts.withColumn("upto", F.sum("count").over(order)).withColumn("n", F.sum("count").over(W.partitionBy(F.lit(0))))
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    hits = upto.select(value, "upto", "count", "n", asked).withColumn("at", F.bround((F.col("n") - 1) * F.col("percent") / 100, 0))
    return hits.where("at >= upto - count AND at < upto").select("percent", F.col(value).alias("value"))


def eligible_columns(coverage: DataFrame, taxa: int, fraction: float) -> DataFrame:
    """Columns covered by at least ceil(fraction * taxa)."""
    return coverage.where(F.col("covered") >= F.ceil(F.lit(fraction) * F.lit(taxa)))


def select_tree(trees: DataFrame, log_likelihood: str = "log_likelihood", newick: str = "newick", by: list[str] | None = None, version: str | None = None) -> DataFrame:
    """The likeliest tree of finite likelihood (and of the version, if one is given); of equals the smaller text.

    A struct's minimum, so that tasks reduce their rows before any meet.
    """
    fine = trees.where(~F.isnan(log_likelihood) & (F.abs(log_likelihood) < float("inf")))
    if version is not None:
        fine = fine.where(F.col("version") == version)
    order = F.struct(-F.col(log_likelihood), F.col(newick))
    found = fine.groupBy(*(by or [])).agg(F.min_by(F.struct(*[F.col(c) for c in trees.columns]), order).alias("tree"))
    return found.where("tree IS NOT NULL").select("tree.*")


def is_nucleotide_log(text: Column) -> Column:
    """By all data types that are told, or else by the names of all models; the case does not matter."""
    kinds = F.regexp_extract_all(text, F.lit(r"(?i)DataType:\s*(\S+)"), F.lit(1))
    models = F.regexp_extract_all(text, F.lit(r"(?im)^Model:\s*([^+\s]+)"), F.lit(1))
    known = F.forall(models, lambda m: F.rlike(F.upper(m), F.lit("^(?:" + "|".join(NUCLEOTIDE_MODELS) + ")")))
    return F.when(F.size(kinds) > 0, F.forall(kinds, lambda t: F.upper(t) == "DNA")).otherwise((F.size(models) > 0) & known)


def alignment_sites(text: Column) -> Column:
    """The first number of sites that a log tells, a plain one before one with patterns; null if there is none."""
    plain = F.regexp_extract(text, r"(?i)Alignment sites:\s*([0-9]+)", 1)
    both = F.regexp_extract(text, r"(?i)Alignment sites\s*/\s*patterns:\s*([0-9]+)\s*/", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(both, F.lit(""))).try_cast("long")


# The columns of a manifest.
MANIFEST = ("dataset", "taxa", "raw_sites", "unique_patterns", "alignment", "pattern_weights", "tree", "normalized_alignment_sha256", "pattern_weights_sha256", "normalized_tree_sha256")


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """dataset, fault for each rule that a row of a manifest breaks."""
    paths, digests, counts = ("alignment", "pattern_weights", "tree"), ("normalized_alignment_sha256", "pattern_weights_sha256", "normalized_tree_sha256"), ("taxa", "raw_sites", "unique_patterns")
    missing = [c for c in MANIFEST if c not in manifest.columns]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    rules = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"{c} is empty")) for c in MANIFEST]
    rules += [F.when(~F.col(c).cast("string").rlike("^[1-9][0-9]*$"), F.lit(f"{c} is not a count")) for c in counts]
    rules += [F.when(F.col(c).rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(f"{c} leaves the folder")) for c in paths]
    rules += [F.when(F.col(c).rlike(r"[\x00-\x1f\x7f]"), F.lit(f"{c} has control characters")) for c in (*paths, "dataset")]
    rules += [F.when(~F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(f"{c} is not a digest")) for c in digests]
    rules.append(F.when(F.col("copies") > 1, F.lit("dataset occurs twice")))
    counted = manifest.withColumn("copies", F.count("*").over(W.partitionBy("dataset")))
    return counted.select("dataset", F.explode(F.array_compact(F.array(*rules))).alias("fault"))


def digest_faults(files: DataFrame, contents: DataFrame) -> DataFrame:
    """files (path, sha256) and contents (path, content) -> path, fault where the content is missing or differs."""
    have = contents.select("path", F.sha2("content", 256).alias("found"))
    return files.join(have, "path", "left").where("found IS NULL OR found <> sha256").select("path", F.when(F.col("found").isNull(), "missing").otherwise("digest differs").alias("fault"))


def write_csv(frame: DataFrame, path: str) -> None:
    """One file with a header; an empty report is an error."""
    if frame.isEmpty():
        raise ValueError("the report is empty")
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_corpus(chosen: DataFrame, order: Sequence[str], excluded: DataFrame, path: str) -> None:
    """``path``/manifest and ``path``/excluded as CSV: the chosen rows by ``order``, what was left out by rank.  Both have their header, also where there is no row."""
    for rows, by, name in ((chosen, list(order), "manifest"), (excluded, ["rank"], "excluded")):
        rows.orderBy(*by).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_metadata(pairs: dict[str, str]) -> str:
    """key=value lines, keys checked, line ends in values made blanks."""
    import re

    for key in pairs:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", key):
            raise ValueError(f"no key: {key!r}")
    return "".join(f"{k}={' '.join(str(v).splitlines())}\n" for k, v in pairs.items())


def write_metadata_rows(pairs: DataFrame, order: list[str], path: str) -> None:
    """As write_metadata(), of rows (key, value, and the columns they are ordered by), as text files that follow each other in their names' order."""
    key = F.when(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_.-]*$"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("no key: "), F.coalesce("key", F.lit("null")))))
    value = F.regexp_replace(F.regexp_replace(F.col("value").cast("string"), r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", " ")
    pairs.orderBy(*order).select(F.concat(key, F.lit("="), F.coalesce(value, F.lit(""))).alias("value")).write.mode("overwrite").text(path)
