"""Quality classifier: interpolated modified Kneser-Ney models of trusted text, two for each language.

One is of characters, order ORDER, and knows how words are spelt; one is of words, order 2 (word_model), and knows
which words there are and what follows what.  Both count all trusted documents but the quarter that is
held out; gram counts are summed in shards, counts of lower orders are continuation counts, and every
order has three discounts from its counts of counts.

Scoring joins counts, it does not hand the models out.  For characters, each block of documents lists its distinct grams
by shard; the shards' distinct grams are joined with counts and contexts order by order, which gives
each gram its log-probability; each block gets back what it asked for, meets its texts (compressed)
and sums by document.  A task holds one block and its grams, or one shard's.

A document is rejected if its smoothed mean log-loss is above the UPPER quantile of the held-out trusted documents of its
language, by characters or by words, or if that of its words by the lowest order alone is below the LOWER quantile of all
trusted ones: text of a few common words again and again.  (The whole model would not do for this limit: it knows copies
of what it was trained on.)  A language without held-out documents has no limits and rejects nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import word_model
from .blocks import located, runs, stored, unpacked
from .common import Scratch, byte_batch, partitions, small, table, trimmed
from .shared_keys import planes, unplanes
from .shingles import word_counts

ORDER = 4
#: Code points up to 65,535 are symbols as they are; those above share the 8,448 places of surrogates and private use.
BITS = 16
SYMBOLS = 1 << BITS
#: Stands before the first character; no text keeps it (code point 1 counts as one more such mark).
START = 1
#: Documents of a block, and symbols handled at once.
BLOCK_ROWS, PIECE = 4_096, 1_000_000
#: Characters and words of average text that a document's means are smoothed with, so that a few prove little.
PRIOR, WORD_PRIOR = 200, 30
#: Quantiles of trusted documents, and one in how many of these is held out.
UPPER, LOWER, HELD_OUT = 0.998, 0.002, 4
#: Steps of the log-loss by which quantiles are counted.
STEP = 0.002
#: Bytes of text to a shard of counts.
SHARD_BYTES = 16 << 20
#: Grams are dealt to shards by their remainder by this prime.
PRIME = 1_000_003


def symbols(text: str) -> np.ndarray:
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    far = np.flatnonzero(s >= SYMBOLS)
    s[far] = 0xD800 + s[far] % 0x2100
    return s


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts end to end, one for each character, and where each text begins (n + 1)."""
    pad = chr(START) * (ORDER - 1)
    joined = symbols(pad + pad.join(texts)) if texts else np.zeros(0, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    m = max(0, len(joined) - ORDER + 1)
    keys = joined[:m].copy()
    for j in range(1, ORDER):
        keys <<= BITS
        keys |= joined[j : j + m]
    begins = np.r_[0, np.cumsum(lengths)]
    own = np.ones(m, bool)  # all but those that end in a pad
    for j in range(ORDER - 1):
        own[begins[1:-1] + np.arange(len(texts) - 1) * (ORDER - 1) + j] = False
    return keys[own], begins


def _pieces(texts: list[str]):
    """Runs of texts of about PIECE characters."""
    a, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= PIECE:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _merge(x: tuple | None, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if x is not None:
        keys, counts = np.concatenate([x[0], keys]), np.concatenate([x[1], counts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _by_shard(keys: np.ndarray, shards: int):
    shard = keys % PRIME % shards
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _counted(batch_texts: dict, into: dict) -> None:
    for lang, texts in batch_texts.items():
        for a, b in _pieces(texts):
            keys = gram_keys(texts[a:b])[0]
            into[lang] = _merge(into.get(lang), *np.unique(keys, return_counts=True))


def _count(shards: int):
    """Gram counts of a block's trusted documents, by shard."""

    def run(texts: pa.Table, trusted: pa.Table) -> pa.Table:
        rids = set(trusted.column("rid").to_pylist())
        counts: dict[str, tuple] = {}
        for _, _, own, langs, bodies in unpacked(texts):
            picked = defaultdict(list)
            for rid, lang, text in zip(own, langs, bodies, strict=True):
                if text and rid in rids:
                    picked[lang].append(text)
            _counted(picked, counts)
        rows = [(s, lang, planes(keys[at]), planes(n[at])) for lang, (keys, n) in counts.items() for s, at in _by_shard(keys, shards)]
        return pa.Table.from_batches([_batch(rows, [pa.int32(), pa.string(), pa.binary(), pa.binary()], ["shard", "lang", "keys", "counts"])])

    return run


def _sum(rows: pa.Table) -> pa.Table:
    total: dict[str, tuple] = {}
    for lang, keys, counts in zip(rows.column("lang").to_pylist(), rows.column("keys"), rows.column("counts"), strict=True):
        total[lang] = _merge(total.get(lang), unplanes(keys.as_buffer(), np.int64), unplanes(counts.as_buffer(), np.int64))
    names = ["lang", "key", "c"]
    parts = [pa.table([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], names=names) for lang, (k, c) in total.items()]
    return pa.concat_tables(parts)


def _asked(shards: int):
    """(block, lang, shard, distinct grams) of the blocks."""

    def run(batches):
        for batch in batches:
            for k, (_, _, _, langs, bodies) in enumerate(unpacked(batch)):
                texts, counts = defaultdict(list), {}
                for lang, text in zip(langs, bodies, strict=True):
                    if text:
                        texts[lang].append(text)
                _counted(texts, counts)
                block = batch.column("block")[k].as_py()
                rows = [(block, lang, s, planes(keys[at])) for lang, (keys, _) in counts.items() for s, at in _by_shard(keys, shards)]
                yield _batch(rows, [pa.int64(), pa.string(), pa.int32(), pa.binary()], ["block", "lang", "shard", "keys"])

    return run


def _distinct(rows: pa.Table) -> pa.Table:
    total: dict[str, list] = defaultdict(list)
    for lang, keys in zip(rows.column("lang").to_pylist(), rows.column("keys"), strict=True):
        total[lang].append(unplanes(keys.as_buffer(), np.int64))
    parts = [(lang, np.unique(np.concatenate(k))) for lang, k in total.items()]
    return pa.concat_tables([pa.table([pa.array([lang] * len(k), pa.string()), pa.array(k)], names=["lang", "key"]) for lang, k in parts])


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    by_lang: dict[str, tuple] = {}
    langs = model.column("lang").to_numpy(zero_copy_only=False)
    keys, logp = model.column("key").to_numpy(), model.column("logp").to_numpy()
    for lang in set(langs):
        own = langs == lang
        order = np.argsort(keys[own])
        by_lang[lang] = keys[own][order], logp[own][order].astype(np.float32)
    rows = []
    for block, lang, grams in zip(asked.column("block").to_pylist(), asked.column("lang").to_pylist(), asked.column("keys"), strict=True):
        k = unplanes(grams.as_buffer(), np.int64)
        have, p = by_lang[lang]
        rows.append((block, lang, planes(k), p[np.searchsorted(have, k)].tobytes()))
    return pa.Table.from_batches([_batch(rows, [pa.int64(), pa.string(), pa.binary(), pa.binary()], ["block", "lang", "keys", "logp"])])


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    press = zstandard.ZstdDecompressor().decompress
    model: dict[str, list] = defaultdict(list)
    words = np.zeros((BLOCK_ROWS, 3))  # of each row of the block: ln p of known words, unknown words, other terms
    for row in range(len(answers)):
        cell = lambda c, row=row: answers.column(c)[row]
        if cell("rid").is_valid:
            rid = unplanes(press(cell("rid").as_buffer()), np.int32)  # each once in a cell
            words[rid] += np.stack([unplanes(press(cell(c).as_buffer()), np.float64) for c in ("lp", "unknown", "rest")], axis=1)
        else:
            model[cell("lang").as_py()].append((unplanes(cell("keys").as_buffer(), np.int64), np.frombuffer(cell("logp").as_buffer(), np.float32)))
    ready = {}
    for lang, parts in model.items():
        keys, logp = np.concatenate([k for k, _ in parts]), np.concatenate([p for _, p in parts])
        order = np.argsort(keys)
        ready[lang] = keys[order], logp[order]
    rows = []
    for columns in unpacked(texts):
        by_lang = defaultdict(list)
        for doc, fp, rid, lang, text in zip(*columns, strict=True):
            if text:
                by_lang[lang].append((doc, fp, rid, text))
            else:
                rows.append((doc, fp, lang, 0, 0.0, 0, 0.0, 0.0, 0.0))
        for lang, docs in by_lang.items():
            have, logp = ready[lang]
            own = [d[-1] for d in docs]
            for a, b in _pieces(own):
                keys, begins = gram_keys(own[a:b])
                sums = np.add.reduceat(logp[np.searchsorted(have, keys)].astype(np.float64), begins[:-1])
                n_words = word_counts(*byte_batch(pa.array(own[a:b], pa.string())))
                for (doc, fp, rid, t), s, n in zip(docs[a:b], sums, n_words, strict=True):
                    rows.append((doc, fp, lang, len(t), -float(s), int(n) + 1, *words[rid].tolist()))
    return pa.Table.from_batches([_batch(rows, _SCORED_TYPES, _SCORED_NAMES)])


_SCORED_SQL = "doc_id long, fp long, lang string, n long, loss double, n_words long, lp double, unknowns double, rest double"
_SCORED_NAMES = [x.split()[0] for x in _SCORED_SQL.split(", ")]
_SCORED_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]


def lower_order(types: DataFrame, order: int) -> DataFrame:
    """Continuation counts: in how many distinct grams of the order above each gram is the end."""
    return types.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("key")).agg(F.count("*").alias("c"))


def discounts(types: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from the counts of counts; each from 0.1 to its count."""
    n = types.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = lambda k: F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k / 2)), F.lit(0.1)), F.lit(float(k)))
    return n.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def log_probabilities(types: DataFrame, asked: DataFrame, store: Scratch) -> DataFrame:
    """types (lang, key, c) of trusted text and asked (lang, key), both of ORDER -> asked with logp, a table of the store."""
    of_order, need = {ORDER: types}, {ORDER: asked}
    for n in range(ORDER - 1, 0, -1):
        of_order[n] = store.put(lower_order(of_order[n + 1], n), f"types{n}")
        need[n] = store.put(need[n + 1].select("lang", F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("key")).distinct(), f"need{n}")
    q = None
    for n in range(1, ORDER + 1):
        c = F.col("c")
        cuts = store.put(discounts(of_order[n]), f"discounts{n}")
        cut = of_order[n].join(small(cuts, 64), "lang").withColumn("d", F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3")))
        before = F.shiftrightunsigned("key", BITS)
        context = cut.groupBy("lang", before.alias("context")).agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = need[n].withColumn("context", before).join(cut.select("lang", "key", (c - F.col("d")).alias("own")), ["lang", "key"], "left").join(context, ["lang", "context"], "left")
        if q is None:
            rows = rows.withColumn("p_low", F.lit(1.0 / SYMBOLS))
        else:
            low = q.select("lang", F.col("key").alias("low"), F.col("p").alias("p_low"))
            rows = rows.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(low, ["lang", "low"])
        p = F.when(F.col("total").isNull(), F.col("p_low")).otherwise(F.coalesce("own", F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("p_low"))
        above = store.put(rows.select("lang", "key", p.alias("p")), f"q{n}")
        store.drop(of_order[n], need[n], cuts, *([] if q is None else [q]))
        q = above
    return q


def losses(docs: DataFrame, trusted: DataFrame, text: str = "text", store: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, languages), tables of the store.

    rows: doc_id, fp, lang, n (characters), loss (sum of -ln p of its characters), n_words (words and the mark of the
    end), lp, unknowns, rest of every row of ``docs``: over its words, the sum of ln p by the lowest order where it knows them, the number
    of others, and what the second order adds.  languages: lang, unknown (ln p of such a word).

    trusted: doc_id of the trusted documents; the models are trained on those that are not held out.  Null texts count
    as empty, with zeros throughout.  A null lang is a language of its own, ''.
    """
    spark = docs.sparkSession
    with store or Scratch(spark, "quality") as store:
        lang = F.coalesce("lang", F.lit("")).alias("lang")
        flat = located(docs, store, BLOCK_ROWS, [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("lang", F.col(f"`{text}`")).alias("fp"), lang, F.col(f"`{text}`").alias("text")])
        n_docs, size = flat.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        shards = max(partitions(spark), size // SHARD_BYTES)
        texts = stored(flat, ["doc_id", "fp", "rid", "lang", "text"], store, min(100_000, max(partitions(spark), n_docs // (2 * BLOCK_ROWS))))
        chosen = store.put(trusted.select("doc_id").distinct(), "trusted")
        flags = flat.where(~held_out(F.col("fp"))).select("doc_id", "block", "rid").join(small(chosen), "doc_id", "left_semi").select("block", "rid")
        flags = store.put(flags, "flags")
        sums, langs = word_model.word_sums(texts, flags, size, store)
        counts = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_count(shards), "shard int, lang string, keys binary, counts binary")
        types = store.put(counts.groupBy("shard").applyInArrow(lambda rows: _sum(rows), "lang string, key long, c long"), "types")
        asked = store.put(texts.mapInArrow(_asked(shards), "block long, lang string, shard int, keys binary"), "asked")
        distinct = store.put(asked.groupBy("shard").applyInArrow(lambda rows: _distinct(rows), "lang string, key long"), "distinct")
        probable = log_probabilities(types, distinct, store)
        model = probable.select("lang", "key", F.ln("p").alias("logp"), F.pmod(F.pmod("key", F.lit(PRIME)), F.lit(shards)).cast("int").alias("shard"))
        answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(lambda a, m: _answer(a, m), "block long, lang string, keys binary, logp binary")
        answers = answers.unionByName(sums, allowMissingColumns=True)
        scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: trimmed(_score(t, a)), _SCORED_SQL)
        scored = store.put(scored, "scored")
        store.drop(texts, chosen, flags, asked, probable)
        return scored, langs


def held_out(fp):
    """By the text, so that its copies are on the same side."""
    return F.pmod(F.xxhash64(F.lit("held out"), fp), F.lit(HELD_OUT)) == 0


def limits(rows: DataFrame, trusted: DataFrame, store: Scratch) -> DataFrame:
    """lang, and of its held-out trusted documents the means, and the limits of the three measures, a table of the store."""
    every = rows.join(small(trusted), "doc_id", "left_semi").where("n > 0").withColumn("held", held_out(F.col("fp")))
    good = every.where("held")
    means = store.put(good.groupBy("lang").agg(*[(F.sum(loss) / F.sum(n)).alias(f"mean_{m}") for m, (loss, n, _) in MEASURES.items()]), "means")
    smooth = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), smoothed(m).alias("x")) for m in MEASURES])).alias("s")
    bins = every.join(small(means, 64), "lang").select("lang", "held", smooth).where("held OR s.m = 'lowest'").groupBy("lang", "s.m", F.floor(F.col("s.x") / STEP).alias("bin")).count()
    upto = F.sum("count").over(W.partitionBy("lang", "m").orderBy("bin"))
    whole = F.sum("count").over(W.partitionBy("lang", "m"))
    shares = bins.select("lang", "m", "bin", (upto / whole).alias("share"))
    at = lambda m, q, side: F.min(F.when((F.col("m") == m) & (F.col("share") >= q), (F.col("bin") + side) * STEP))
    found = shares.groupBy("lang").agg(at("characters", UPPER, 1).alias("limit_characters"), at("words", UPPER, 1).alias("limit_words"), at("lowest", LOWER, 0).alias("limit_lowest"))
    out = store.put(means.join(found, "lang"), "limits")
    store.drop(means)
    return out


#: Measure: its sum of losses, what that is divided by, and how much average text smooths it.
MEASURES = {"characters": ("loss", "n", PRIOR), "words": ("word_loss", "n_words", WORD_PRIOR), "lowest": ("lowest_loss", "n_words", WORD_PRIOR)}


def smoothed(measure: str):
    loss, n, prior = MEASURES[measure]
    return (F.col(loss) + prior * F.col(f"mean_{measure}")) / (F.col(n) + prior)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", store: Scratch | None = None) -> DataFrame:
    """doc_id, fp, lang, n_symbols, log_loss (smoothed mean by characters), perplexity, limit, word_loss, word_limit, lowest_loss,
    lowest_limit, keep of every row of ``docs``.

    Trusted are the documents labelled quality 1 and toxic 0.  perplexity and limit are exp of mean log-losses by characters;
    the decisions compare the smoothed means with their limits.  Documents without characters are kept.
    Without labels nothing is rejected.  An empty table gives an empty one.  Whoever gives ``store`` closes it once the
    result is written.
    """
    with store or Scratch(docs.sparkSession, "quality") as store:
        trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        trusted = store.put(trusted, "trusted")
        rows, langs = losses(docs, trusted, text, store)
        lowest = -(F.col("lp") + F.col("unknowns") * F.col("unknown"))
        rows = rows.join(small(langs, 64), "lang", "left").withColumn("lowest_loss", lowest).withColumn("word_loss", lowest - F.col("rest"))
        judged = rows.join(small(limits(rows, trusted, store), 64), "lang", "left")
        fine = (smoothed("characters") <= F.col("limit_characters")) & (smoothed("words") <= F.col("limit_words")) & (smoothed("lowest") >= F.col("limit_lowest"))
        return judged.select(
            "doc_id", "fp", "lang", F.col("n").alias("n_symbols"), smoothed("characters").alias("log_loss"),
            F.exp(F.try_divide(F.col("loss"), F.col("n"))).alias("perplexity"), F.exp("limit_characters").alias("limit"),
            smoothed("words").alias("word_loss"), F.col("limit_words").alias("word_limit"),
            smoothed("lowest").alias("lowest_loss"), F.col("limit_lowest").alias("lowest_limit"),
            F.coalesce((F.col("n") == 0) | fine, F.lit(True)).alias("keep"),
        )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("fp")
