"""Queries over text that is made from the test tables: trees, alignments, archives, digests and what checks them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import randomness
from ..operators import corpus, encode, prepare
from ..sources import ranges
from ..sources import text as sources
from ..streaming.streams import folder
from .catalog import _sequences, query
from .derive import kept, observations, read

# --- Newick

_LEN = "(s_suppkey % 8) / 8.0"


def _trees(spark, d) -> DataFrame:
    """path, text: one tree a nation, its suppliers the leaves, with quotes, blanks and comments."""
    leaf = F.concat(F.lit("'Sup''"), F.col("s_suppkey").cast("string"), F.lit("' : "), (F.col("s_suppkey") % 8 / 8.0).cast("string"))
    rows = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", leaf.alias("leaf")))).alias("leaves"))
    body = F.array_join(F.transform("leaves", lambda x: x["leaf"]), " , [a [nested] note] ")
    return rows.select(F.col("s_nationkey").cast("string").alias("path"), F.concat(F.lit(" ( "), body, F.lit(" )n"), F.col("s_nationkey").cast("string"), F.lit(":0.5 ;\n")).alias("text"))


@query(f"""SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS node_id, 0 AS parent_id, 'Sup''' || s_suppkey AS label, CAST({_LEN} AS DOUBLE) AS branch_length FROM supplier
UNION ALL SELECT DISTINCT CAST(s_nationkey AS VARCHAR), 0, NULL, 'n' || s_nationkey, 0.5 FROM supplier""")
def newick_parse(spark, d):
    return sources.newick_nodes(_trees(spark, d))


@query(f"""SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, '(' || string_agg('''Sup''''' || s_suppkey || ''':' || CAST(CAST({_LEN} AS DOUBLE) AS VARCHAR), ',' ORDER BY s_suppkey) || ')n' || s_nationkey || ';' AS newick FROM supplier GROUP BY s_nationkey""")
def newick_write(spark, d):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"tree_id": pdf["path"], "newick": [sources.write_newick(sources.parse_newick(t)) for t in pdf["text"]]})

    return _trees(spark, d).mapInPandas(run, "tree_id string, newick string")


@query(f"SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, count(*) AS leaves, round(max({_LEN}), 6) AS height, round(sum({_LEN}), 6) AS total FROM supplier GROUP BY 1")
def newick_source(spark, d):
    """Trees written as files and read through the data source."""
    path = folder(spark, "trees")
    _trees(spark, d).repartition("path").write.partitionBy("path").text(path)
    spark.dataSource.register(sources.NewickSource)
    nodes = spark.read.format("newick").load(path)
    leaves = nodes.where("parent_id IS NOT NULL").withColumn("tree_id", F.regexp_extract("tree_id", "path=([0-9]+)", 1))
    return leaves.groupBy("tree_id").agg(F.count("*").alias("leaves"), F.round(F.max("branch_length"), 6).alias("height"), F.round(F.sum("branch_length"), 6).alias("total"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, 's' || s_suppkey AS label FROM supplier")
def label_cut(spark, d):
    """Labels end at their first comma, whatever bytes follow."""
    leaf = F.concat(F.lit("'s"), F.col("s_suppkey").cast("string"), F.lit(", étude':1"))
    rows = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(leaf), ",").alias("body"))
    texts = rows.select(F.col("s_nationkey").cast("string").alias("path"), F.encode(F.concat(F.lit("("), "body", F.lit(")[note ü];")), "iso-8859-1").alias("content"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [prepare.cut_labels(bytes(c)) for c in pdf["content"]]})

    nodes = sources.newick_nodes(texts.mapInPandas(run, "path string, text string"))
    return nodes.where("parent_id IS NOT NULL").select("tree_id", "label")


# --- sequences

_LETTER = "substr('ACGTRYSWKMBDHVN-', CAST((s_suppkey * (k + 3) + k) % 16 + 1 AS INTEGER), 1)"
_SEQ = f"SELECT s_nationkey, s_suppkey, string_agg({_LETTER}, '' ORDER BY k) AS sequence FROM supplier, range(12) r(k) GROUP BY 1, 2"


def _letters(n: int):
    key = F.col("s_suppkey")
    return F.concat(*[F.substring(F.lit("ACGTRYSWKMBDHVN-"), ((key * (k + 3) + k) % 16 + 1).cast("int"), F.lit(1)) for k in range(n)])


def _records(spark, d, record) -> DataFrame:
    """path, text: one file a nation, ``record`` of each supplier in a row, rising."""
    rows = read(spark, d, "supplier").withColumn("sequence", _letters(12)).withColumn("record", record)
    grouped = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "record", "sequence"))).alias("r"))
    return grouped.select(F.col("s_nationkey").cast("string").alias("path"), F.transform("r", lambda x: x["record"]).alias("records"), "r")


_SEQ_SQL = f"SELECT CAST(s_nationkey AS VARCHAR) AS alignment_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS record_idx, 's' || s_suppkey AS name, sequence FROM ({_SEQ})"


@query(_SEQ_SQL)
def fasta_parse(spark, d):
    """Headers with further words, lower case, blanks inside of lines, wrapped lines."""
    seq = F.lower("sequence")
    record = F.concat(F.lit(">s"), F.col("s_suppkey").cast("string"), F.lit(" of a nation\r\n "), seq.substr(1, 5), F.lit(" \n\n"), seq.substr(6, 3), F.lit(" "), seq.substr(9, 4), F.lit("\n"))
    return sources.fasta_sequences(_records(spark, d, record).select("path", F.array_join("records", "").alias("text")))


@query(f"SELECT '>s' || s_suppkey || chr(10) || array_to_string(list_transform(range(0, 240, 80), lambda x: substr(repeat(sequence, 20), CAST(x + 1 AS INTEGER), 80)), chr(10)) AS value FROM ({_SEQ})")
def fasta_wrap(spark, d):
    rows = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.repeat(_letters(12), 20).alias("sequence"))
    return sources.wrap_fasta(rows)


def _phylip_head(rows: DataFrame) -> DataFrame:
    return rows.where("size(records) > 0").withColumn("head", F.concat(F.lit(" "), F.size("records").cast("string"), F.lit(" 12\n")))


@query(_SEQ_SQL)
def phylip_parse(spark, d):
    record = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("   "), F.col("sequence").substr(1, 7), F.lit(" "), F.col("sequence").substr(8, 5), F.lit("\n"))
    rows = _phylip_head(_records(spark, d, record))
    return sources.phylip_sequences(rows.select("path", F.concat("head", F.array_join("records", "")).alias("text")))


@query(_SEQ_SQL)
def phylip_interleaved(spark, d):
    """A second block without names and a third that repeats them."""
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    rows = _phylip_head(_records(spark, d, name))
    block = lambda a, n, named: F.array_join(F.transform("r", lambda x: F.concat(F.concat(x["record"], F.lit(" ")) if named else F.lit(""), x["sequence"].substr(a, n), F.lit("\n"))), "")
    return sources.phylip_sequences(rows.select("path", F.concat("head", block(1, 6, True), F.lit("\n"), block(7, 4, False), F.lit("\n"), block(11, 2, True)).alias("text")))


@query(f"SELECT 's' || s_suppkey AS name, sequence FROM ({_SEQ})")
def fasta_ranges(spark, d):
    """FASTA files read by byte ranges that end anywhere, records put together from them."""
    path = folder(spark, "fasta")
    record = F.concat(F.lit(">s"), F.col("s_suppkey").cast("string"), F.lit("\n"), F.col("sequence").substr(1, 5), F.lit("\n"), F.col("sequence").substr(6, 100))
    _records(spark, d, record).repartition(3, "path").select(F.array_join("records", "\n").alias("value")).write.text(path)
    return ranges.fasta_files(spark, path, kept(spark, "fasta"), 100).select("name", "sequence")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS path, count(*) AS sequences FROM supplier GROUP BY 1 UNION ALL SELECT CAST(s_nationkey AS VARCHAR) || 'x', count(*) FROM supplier GROUP BY s_nationkey")
def archive_members(spark, d):
    """Zip and compressed tar archives, each of a FASTA file and another, written as files and read by byte ranges and members."""
    record = F.concat(F.lit(">s"), F.col("s_suppkey").cast("string"), F.lit("\n"), "sequence", F.lit("\n"))
    texts = _records(spark, d, record).select("path", F.array_join("records", "").alias("text"))

    def pack(batches):
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["text"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("notes.txt", "no sequences")
                    z.writestr("data/all.fasta", body)
                    z.comment = b"\n"  # the line feed that the text writer adds
                rows += [(path, out.getvalue()[:-1], None), (path + "x", None, prepare.tar_of({"notes.txt": b"none", "all.fa": body.encode()}, "w"))]
            yield pd.DataFrame(rows, columns=["path", "zip", "tar"])

    archives = texts.mapInPandas(pack, "path string, zip binary, tar binary")
    where = folder(spark, "archives")
    for kind, packed in (("zip", "none"), ("tar", "gzip")):
        files = archives.where(F.col(kind).isNotNull()).select("path", F.col(kind).cast("string").alias("value"))
        files.repartition("path").write.partitionBy("path").option("compression", packed).text(f"{where}/{kind}")
    found = prepare.archived_sequences(spark, [f"{where}/zip", f"{where}/tar"], kept(spark, "archives"), 4_096)
    return found.groupBy(F.regexp_extract("file", "path=([^/]+)", 1).alias("path")).agg(F.count("*").alias("sequences"))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS pattern, CAST(s_suppkey + 1 AS BIGINT) AS weight FROM supplier")
def weights_scan(spark, d):
    suppliers, path = read(spark, d, "supplier"), folder(spark, "weights")
    line = suppliers.agg(F.array_sort(F.collect_list("s_suppkey")).alias("k")).select(F.array_join(F.transform("k", lambda x: (x + 1).cast("string")), " \n ").alias("value"))
    line.coalesce(1).write.text(path)
    return prepare.pattern_weights(spark, path, suppliers.count())


def _families(spark, d) -> DataFrame:
    """path, text: one flat file a region with a family a nation, its suppliers the sequences."""
    record = F.concat(F.lit("NAM   s"), F.col("s_suppkey").cast("string"), F.lit("\nDSQ   "), F.col("sequence").substr(1, 8), F.lit("\nDSQ   "), F.col("sequence").substr(9, 4), F.lit("\n"))
    rows = _records(spark, d, record).join(read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), "n_nationkey", "n_regionkey"), "path")
    family = F.concat(F.lit("FAM   F"), "path", F.lit("\nDMK   xx.x.x\nDMK   ..xxxx\n"), F.array_join("records", ""), F.lit("//\n"))
    return rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", family.alias("f")))).alias("f")).select(F.col("n_regionkey").cast("string").alias("path"), F.array_join(F.transform("f", lambda x: x["f"]), "").alias("text"))


@query(f"SELECT 'F' || s_nationkey AS family, 's' || s_suppkey AS name, substr(sequence, 1, 2) || substr(sequence, 4, 1) || substr(sequence, 6, 1) || substr(sequence, 9, 4) AS sequence FROM ({_SEQ})")
def family_masks(spark, d):
    """Families of flat files, each sequence cut to the columns that the family's mask keeps."""
    return sources.flat_families(_families(spark, d)).select("family", F.col("name"), F.col("masked").alias("sequence"))


@query("SELECT family, leaves FROM (SELECT 'F' || s_nationkey AS family, count(*) AS leaves, s_nationkey FROM supplier GROUP BY s_nationkey) WHERE leaves BETWEEN 2 AND 9 AND s_nationkey % 3 <> 1 ORDER BY s_nationkey LIMIT 6")
def family_filter(spark, d):
    rows = sources.flat_families(_families(spark, d)).groupBy("family").agg(F.count("*").alias("leaves"))
    rows = rows.withColumn("position", F.substring("family", 2, 9).cast("int"))
    return corpus.choose_families(rows, "leaves", 2, 9, [f"F{k}" for k in range(25) if k % 3 != 1], 6).select("family", "leaves")


# --- joins that must come out even


@query("SELECT 'left only' AS side, count(*) AS n, string_agg(s_name, ', ' ORDER BY s_name) FILTER (place <= 5) AS sample FROM (SELECT s_name, row_number() OVER (ORDER BY s_name) AS place FROM supplier WHERE s_suppkey % 10 IN (3, 7)) HAVING count(*) > 0 UNION ALL SELECT 'right only', count(*), string_agg(n, ', ' ORDER BY n) FILTER (place <= 5) FROM (SELECT s_name || 'x' AS n, row_number() OVER (ORDER BY s_name || 'x') AS place FROM supplier WHERE s_suppkey % 10 = 7) HAVING count(*) > 0")
def taxon_faults(spark, d):
    leaves, sequences = _sequences(spark, d)
    other = sequences.where("s_suppkey % 10 <> 3").withColumn("name", F.when(F.col("s_suppkey") % 10 == 7, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return encode.taxon_faults(leaves.select(F.col("label").alias("name")), other)


# --- identities, digests, logs of analyses


@query("""SELECT name, CASE WHEN kind = 0 THEN 'synthetic-jc69-' || t || '-' || a || '-' || b || '-' || h ELSE name END AS canonical FROM (
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'synthetic-jc69-' || t || '-00' || l_suppkey || '-0' || l_linenumber || '-' || ['0.1', '1e-3', '0.25', '1E2', '0.0500'][CAST(l_partkey % 5 + 1 AS INTEGER)] ELSE 'set-00' || l_suppkey END AS name, l_linenumber % 2 AS kind, t, l_suppkey AS a, l_linenumber AS b,
['0.10000000000000001', '0.001', '0.25', '100', '0.050000000000000003'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS h FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey % 5 AS l_partkey, ['yule', 'beta-critical'][CAST(l_suppkey % 2 + 1 AS INTEGER)] AS t FROM lineitem))""")
def canonical_names(spark, d):
    x = read(spark, d, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_partkey") % 5).alias("p")).distinct()
    kind = F.when(F.col("l_suppkey") % 2 == 0, "yule").otherwise("beta-critical")
    height = F.get(F.array(*map(F.lit, ("0.1", "1e-3", "0.25", "1E2", "0.0500"))), F.col("p").cast("int"))
    number = lambda c: F.col(c).cast("string")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("synthetic-jc69-"), kind, F.lit("-00"), number("l_suppkey"), F.lit("-0"), number("l_linenumber"), F.lit("-"), height)).otherwise(F.concat(F.lit("set-00"), number("l_suppkey")))
    return x.select(name.alias("name")).select("name", prepare.canonical_dataset(F.col("name")).alias("canonical"))


_LOGS = [
    ("DataType: dna\nModel: GTR+G", 1, "Alignment sites: 120"),
    ("datatype: DNA\nDataType: AA", 0, "alignment sites / patterns: 77 / 30"),
    ("Model: gtr+I\nModel: HKY", 1, "Alignment sites / patterns: 5 / 4\nAlignment sites: 9"),
    ("Model: LG+G4\nModel: GTR", 0, ""),
    ("no such thing", 0, "Alignment sites: none"),
]


@query("""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, [true, false, true, false, false][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS nucleotides, CAST([120, 77, 9, NULL, NULL][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS BIGINT) AS sites FROM supplier""")
def analysis_logs(spark, d):
    logs = F.array(*[F.lit(f"a log\n{kind}\n{sites}\nend") for kind, _, sites in _LOGS])
    rows = read(spark, d, "supplier").select("s_suppkey", F.get(logs, (F.col("s_suppkey") % 5).cast("int")).alias("log"))
    return rows.select("s_suppkey", corpus.is_nucleotide_log(F.col("log")).alias("nucleotides"), corpus.alignment_sites(F.col("log")).alias("sites"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, round((CAST('0x' || substr(sha256(n_name), 1, 8) AS BIGINT) / 4294967295.0 * 2 - 1) * 0.16, 9) AS jitter FROM nation")
def jitters(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.round(randomness.jitter(F.col("n_name")), 9).alias("jitter"))


@query("""SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(range(1, strlen(n_name) + 1), lambda i: ascii(substr(n_name, CAST(i AS INTEGER), 1))::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS fingerprint FROM nation""")
def fingerprints(spark, d):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n_nationkey": pdf["n_nationkey"], "fingerprint": [str(randomness.fnv1a(x.encode())) for x in pdf["n_name"]]})

    return read(spark, d, "nation").select("n_nationkey", "n_name").mapInPandas(run, "n_nationkey int, fingerprint string")


@query("SELECT 'doc-' || doc_id AS path, CASE WHEN doc_id % 5 = 1 THEN 'missing' ELSE 'digest differs' END AS fault FROM documents WHERE doc_id % 5 IN (1, 2) AND text IS NOT NULL")
def digest_faults(spark, d):
    """Texts as files: every fifth is not there and every fifth has another digest."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    listed = docs.select("path", F.sha2(F.when(F.col("doc_id") % 5 == 2, F.lit(b"x")).otherwise(F.col("content")), 256).alias("sha256"))
    return corpus.digest_faults(listed, docs.where("doc_id % 5 <> 1").select("path", "content"))


_MANIFEST_SQL = "SELECT CASE WHEN s_suppkey % 13 = 12 THEN 'set-11' ELSE 'set-' || s_suppkey END AS dataset, s_suppkey % 13 AS k FROM supplier WHERE s_suppkey % 13 <> 11 OR s_suppkey = 11"


@query(f"""WITH m AS ({_MANIFEST_SQL}), c AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM m)
SELECT dataset, 'taxa is not a count' AS fault FROM c WHERE k IN (1, 2) UNION ALL SELECT dataset, 'alignment leaves the folder' FROM c WHERE k IN (3, 4) UNION ALL SELECT dataset, 'tree has control characters' FROM c WHERE k = 5
UNION ALL SELECT dataset, 'normalized_tree_sha256 is not a digest' FROM c WHERE k = 6 UNION ALL SELECT dataset, 'alignment is empty' FROM c WHERE k = 7 UNION ALL SELECT dataset, 'dataset occurs twice' FROM c WHERE n > 1""")
def manifest_faults(spark, d):
    k, s = F.col("s_suppkey") % 13, F.col("s_suppkey")
    rows = read(spark, d, "supplier").where((k != 11) | (s == 11))
    digest = F.sha2(s.cast("string"), 256)
    manifest = rows.select(
        F.concat(F.lit("set-"), F.when(k == 12, F.lit("11")).otherwise(s.cast("string"))).alias("dataset"),
        F.when(k == 1, "0").when(k == 2, "many").otherwise("12").alias("taxa"), F.lit("30").alias("raw_sites"), F.lit("20").alias("unique_patterns"),
        F.when(k == 3, "../a.fasta").when(k == 4, "/a.fasta").when(k == 7, "").otherwise("a.fasta").alias("alignment"), F.lit("w.txt").alias("pattern_weights"),
        F.when(k == 5, "a\tb.nwk").otherwise("a.nwk").alias("tree"), digest.alias("normalized_alignment_sha256"), digest.alias("pattern_weights_sha256"),
        F.when(k == 6, "abc").otherwise(digest).alias("normalized_tree_sha256"),
    )
    return corpus.manifest_faults(manifest)


@query("""SELECT CAST(problem AS BIGINT) AS problem, round(max(ll), 6) AS log_likelihood, min_by(newick, (-ll, newick)) AS newick FROM (SELECT l_suppkey AS problem, -round(l_extendedprice / 5000) AS ll, 'tree' || l_orderkey || '-' || l_linenumber AS newick FROM lineitem WHERE l_linenumber % 2 = 1) GROUP BY 1""")
def select_tree(spark, d):
    trees = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("problem"), F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(-F.round(F.col("l_extendedprice") / 5000)).alias("log_likelihood"),
        F.concat(F.lit("tree"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("newick"),
        F.when(F.col("l_linenumber") % 2 == 1, "standard").otherwise("other").alias("version"),
    )
    return corpus.select_tree(trees, by=["problem"], version="standard").select("problem", F.round("log_likelihood", 6).alias("log_likelihood"), "newick")


# --- the two passes over an alignment


@query("""WITH c AS (SELECT s_suppkey, k, CASE WHEN k % 4 = 3 AND s_suppkey % 3 <> 0 THEN 'N' ELSE substr('ACGT', CAST((s_suppkey + k) % 4 + 1 AS INTEGER), 1) END AS ch FROM supplier, range(12) r(k)),
kept AS (SELECT k FROM c GROUP BY 1 HAVING count_if(ch <> 'N') >= ceil(0.5 * (SELECT count(*) FROM supplier)))
SELECT 's' || s_suppkey AS name, string_agg(ch, '' ORDER BY k) AS sequence FROM c JOIN kept USING (k) GROUP BY s_suppkey""")
def two_pass(spark, d):
    key = F.col("s_suppkey")
    letter = lambda k: F.substring(F.lit("ACGT"), ((key + k) % 4 + 1).cast("int"), F.lit(1))
    cells = [F.when(key % 3 != 0, "N").otherwise(letter(k)) if k % 4 == 3 else letter(k) for k in range(12)]
    sequences = read(spark, d, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("name"), F.concat(*cells).alias("sequence"))
    return prepare.two_pass(sequences, 0.5, folder(spark, "two-pass"))[1]


@query(f"SELECT CAST(site AS BIGINT) AS site, count(*) AS observed FROM (SELECT DISTINCT l_orderkey % 512 AS site, l_suppkey FROM lineitem) WHERE site >= 500 AND site < 512 GROUP BY 1")
def last_sites(spark, d):
    return encode.select_sites(observations(spark, d), 500, 12, 512).groupBy("site").agg(F.count("*").alias("observed"))
