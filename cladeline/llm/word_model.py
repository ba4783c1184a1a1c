"""Interpolated modified Kneser-Ney bigram model of words, one for each language, scored by sharded count joins.

With s(v, w) the discounted share of w after v, g(v) the mass that v leaves to the lower order and
p1(w) the lower order, which counts the words that w follows:

    ln p(w | v) = ln p1(w) + ln g(v) + ln(1 + s(v, w) / (g(v) p1(w))),

where an unseen v has ln g = 0 and an unseen pair no last term.  So a text's log-probability is a sum of terms of single
words and of single pairs.  Each block of documents sends its distinct words and pairs, with the number of the
document, to the shards that hold the model's terms; a shard sends back one sum a document.  No task holds the
model or the corpus.  Counts are of all trusted documents; types grow with the corpus and so does the width of
the hashes that name them.

Blocks ask in turns, by the size of the corpus up to TURNS, so each text is read once for it; a turn's answers are added up by
document before the next turn, so that the disk holds a part of what is asked and answered at a time.  The model's
terms are made once, in as many turns, in a table bucketed by shard: each turn of asking reads it where it lies.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import runs, unpacked
from .common import Scratch, byte_batch, partitions, small, trimmed
from .shared_keys import planes, steps, unplanes, unsteps
from .shingles import chunked_words, mixed

#: Parts of the packed texts that ask one after the other: more of them need less disk and read the model more often.
TURNS = 6
#: Bytes of text to a turn, as long as there are fewer.
TURN_BYTES = 128 << 20
#: Words (with repetition) of a shard of pairs, about, and bytes to a word.  Words have half as many shards.
SHARD_WORDS, WORD_BYTES = 2_000_000, 6
#: Words and pairs are named by hashes of log2(bytes of all texts) and so many bits, 64 at most.
SPARE_BITS = 20
#: Packed rows of a turn at most, however many turns that takes, so that a common word's documents do not all meet in one task.
TURN_ROWS = 65_536

_FIRST, _LAST = np.uint64(0x51ED_270B_9E37_0001), np.uint64(0xA076_1D64_78BD_642F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def sequences(texts: list[str], langs: list[str], bits: int):
    """(words, starts, row of each): the words' names with a mark before and after each text, and where texts begin (n + 1)."""
    raw, offsets = byte_batch(pa.array(texts, pa.string()))
    hashes, first = chunked_words(raw, offsets)
    salts = np.array([_salt(x) for x in langs], np.uint64)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(texts)), counts + 2)
    starts = first + 2 * np.arange(len(texts) + 1)
    seq = np.empty(len(row), np.uint64)
    inner = np.ones(len(row), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    seq[starts[:-1]], seq[starts[1:] - 1] = _FIRST, _LAST
    seq[inner] = hashes
    return mixed(seq ^ salts[row]) & _mask(bits), starts, row


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << 64) - (1 << (64 - bits)))


def pair_names(seq: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, second word, row) of every pair inside a text."""
    inside = row[1:] == row[:-1]
    v, w = seq[:-1][inside], seq[1:][inside]
    return mixed(v * _ODD + w) & _mask(bits), v, w, row[1:][inside]


def _shard(names: np.ndarray, shards: int) -> np.ndarray:
    return (((names >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _dealt(shard: np.ndarray):
    """(shard, places) of each shard met; rising names stay rising."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(order) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TYPES = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("v", pa.binary()), ("w", pa.binary()), ("c", pa.binary())])
_TYPES_SQL = "shard int, lang string, v binary, w binary, c binary"


def _packed_types(shard: int, lang: str, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple:
    press = zstandard.ZstdCompressor(level=1).compress
    return shard, lang, press(steps(v)), press(planes(w)), press(planes(c))


def _open_types(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    free = zstandard.ZstdDecompressor().decompress
    return unsteps(free(row["v"])), unplanes(free(row["w"]), np.uint64), unplanes(free(row["c"]), np.int64)


def _summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.zeros(0, np.int64)
    return v[new], w[new], np.add.reduceat(c, new) if len(new) else c


def _count(shards: int, bits: int):
    """Pair counts of a block's documents to train on, by language and shard of the first word."""

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        rids, rows = set(flags.column("rid").to_pylist()), []
        for _, _, own, langs, bodies in unpacked(texts):
            by_lang: dict[str, list[str]] = {}
            for rid, lang, text in zip(own, langs, bodies, strict=True):
                if text and rid in rids:
                    by_lang.setdefault(lang, []).append(text)
            for lang, chosen in by_lang.items():
                seq, _, row = sequences(chosen, [lang] * len(chosen), bits)
                _, v, w, _ = pair_names(seq, row, bits)
                v, w, c = _summed(v, w, np.ones(len(v), np.int64))
                rows += [_packed_types(s, lang, v[at], w[at], c[at]) for s, at in _dealt(_shard(v, shards))]
        return _rows(rows, _TYPES)

    return run


def _merge(rows: pa.Table) -> pa.Table:
    by_lang: dict[str, list] = {}
    for row in rows.to_pylist():
        by_lang.setdefault(row["lang"], []).append(_open_types(row))
    shard = rows.column("shard")[0].as_py()
    return _rows([_packed_types(shard, lang, *_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))) for lang, parts in by_lang.items()], _TYPES)


def _followed(batches):
    """(lang, w, n): in how many pairs w comes second."""
    for batch in batches:
        for row in batch.to_pylist():
            w, n = np.unique(_open_types(row)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(w), pa.string()), pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "w", "n"])


def _counts_of_counts(batches):
    for batch in batches:
        for row in batch.to_pylist():
            n = np.bincount(np.minimum(_open_types(row)[2], 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]], pa.string()), *(pa.array([int(x)], pa.int64()) for x in n[1:5])], names=["lang", "n1", "n2", "n3", "n4"])


def discount(n: str, k: int) -> Column:
    """The modified Kneser-Ney discount of count k from the counts of counts {n}1 to {n}4; from 0.1 to k."""
    at = lambda i: F.col(f"{n}{i}").cast("double")
    y = F.try_divide(at(1), at(1) + 2 * at(2))
    return F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(at(k + 1), at(k)), F.lit(k / 2)), F.lit(0.1)), F.lit(float(k)))


_PAIRS = pa.schema([("shard", pa.int32()), ("w", pa.binary()), ("name", pa.binary()), ("ratio", pa.binary())])
_PAIRS_SQL = "shard int, w binary, name binary, ratio binary"


def _shares(row: dict) -> tuple[np.ndarray, ...]:
    """v, w, discounted share, and for each distinct v its place and the mass it leaves."""
    v, w, c = _open_types(row)
    d = np.array([0.0, row["b1"], row["b2"], row["b3"]])[np.minimum(c, 3)]
    new = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    total = np.add.reduceat(c, new)
    left = np.add.reduceat(d, new) / total
    each = np.diff(np.r_[new, len(v)])
    return v, w, (c - d) / np.repeat(total, each), new, left


def _contexts(batches):
    for batch in batches:
        for row in batch.to_pylist():
            v, _, _, new, left = _shares(row)
            yield pa.RecordBatch.from_arrays([pa.array(v[new].view(np.int64)), pa.array(np.log(left))], names=["key", "lg"])


def _ratios(by_word: int, by_pair: int, bits: int, turn: int, turns: int):
    """s(v, w) / g(v) of the pairs of a turn, by the shard of w."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                v, w, share, new, left = _shares(row)
                ratio = (share / np.repeat(left, np.diff(np.r_[new, len(v)]))).astype(np.float32)
                name = mixed(v * _ODD + w) & _mask(bits)
                mine = np.flatnonzero(_shard(name, by_pair) % turns == turn)
                order = mine[np.argsort(w[mine])]
                w, name, ratio = w[order], name[order], ratio[order]
                rows += [(s, press(steps(w[at])), press(planes(name[at])), press(ratio[at].tobytes())) for s, at in _dealt(_shard(w, by_word))]
            yield from _rows(rows, _PAIRS).to_batches()

    return run


_TERMS = pa.schema([("shard", pa.int32()), ("name", pa.binary()), ("term", pa.binary())])
_TERMS_SQL = "shard int, name binary, term binary"


def _pair_terms(shards: int):
    """ln(1 + ratio / p1(w)) of a shard's pairs, by the shard of the pair."""

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        free, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        keys, lp = words.column("key").to_numpy().view(np.uint64), words.column("lp").to_numpy()
        order = np.argsort(keys)
        keys, lp, names, terms = keys[order], lp[order], [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for row in pairs.to_pylist():
            w = unsteps(free(row["w"]))
            names.append(unplanes(free(row["name"]), np.uint64))
            terms.append(np.log1p(np.frombuffer(free(row["ratio"]), np.float32) * np.exp(-lp[np.searchsorted(keys, w)])).astype(np.float32))
        # dealt once for all rows: a row each would send as many as there are shards, from every row of every shard
        name, term = np.concatenate(names), np.concatenate(terms)
        order = np.argsort(name)
        name, term = name[order], term[order]
        rows = [(s, press(steps(name[at])), press(term[at].tobytes())) for s, at in _dealt(_shard(name, shards))]
        return _rows(rows, _TERMS)

    return run


#: A shard's part of the model, names rising: of words (shards from by_pair on) ln p1 and ln g, of pairs their terms as rest.
_MODEL = pa.schema([("shard", pa.int32()), ("name", pa.binary()), ("lp", pa.binary()), ("rest", pa.binary())])
_MODEL_SQL = "shard int, name binary, lp binary, rest binary"


def _word_model(words: pa.Table) -> pa.Table:
    press = zstandard.ZstdCompressor(level=1).compress
    keys = words.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    row = words.column("shard")[0].as_py(), press(steps(keys[order])), *(press(words.column(c).to_numpy()[order].tobytes()) for c in ("lp", "lg"))
    return trimmed(_rows([row], _MODEL))


def _pair_model(terms: pa.Table) -> pa.Table:
    free, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    rows = terms.to_pylist()
    name = np.concatenate([unsteps(free(row["name"])) for row in rows])
    term = np.concatenate([np.frombuffer(free(row["term"]), np.float32) for row in rows])
    order = np.argsort(name)
    return trimmed(_rows([(rows[0]["shard"], press(steps(name[order])), None, press(term[order].tobytes()))], _MODEL))


_ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("name", pa.binary()), ("rid", pa.binary()), ("n", pa.binary())])
_ASKED_SQL = "shard int, block long, name binary, rid binary, n binary"


def _ask(by_word: int, by_pair: int, bits: int):
    """A packed row's distinct (word, document) and (pair, document), and how often each occurs; sorted by name."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for k, (_, _, rids, langs, bodies) in enumerate(unpacked(batch)):
                block = batch.column("block")[k].as_py()
                some = [i for i, text in enumerate(bodies) if text]
                if not some:
                    continue
                words, _, row = sequences([bodies[i] for i in some], [langs[i] for i in some], bits)
                pairs, _, _, pair_row = pair_names(words, row, bits)
                numbers = np.array([rids[i] for i in some], np.int32)
                for first, shards, name, at_row in ((by_pair, by_word, words, row), (0, by_pair, pairs, pair_row)):
                    order = np.argsort(name, kind="stable")  # documents rise already; where they don't, one is met twice
                    name, rid = name[order], numbers[at_row[order]]
                    new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (rid[1:] != rid[:-1])])
                    n = np.diff(np.r_[new, len(name)]).astype(np.int32)
                    name, rid = name[new], rid[new]
                    rows = [(first + s, block, press(steps(name[a:b])), press(planes(rid[a:b])), press(planes(n[a:b]))) for s, a, b in _stretches(_shard(name, shards))]
                    yield from _rows(rows, _ASKED).to_batches()
                trimmed()

    return run


def _stretches(shard: np.ndarray):
    """(shard, begin, end) of rising shards."""
    return ((int(shard[a]), a, b) for a, b in runs(shard))


SUMS = pa.schema([("block", pa.int64()), ("rid", pa.binary()), ("lp", pa.binary()), ("unknown", pa.binary()), ("rest", pa.binary())])
SUMS_SQL = "block long, rid binary, lp binary, unknown binary, rest binary"


def _sums(by_pair: int):
    """The terms of what a shard is asked, summed by document; what is zero throughout is left out."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        if not len(asked):
            return _rows([], SUMS)
        free, press, rows = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress, []
        words = asked.column("shard")[0].as_py() >= by_pair
        own = model.to_pylist()  # one row, or none
        keys = np.concatenate([*(unsteps(free(row["name"])) for row in own), np.zeros(1, np.uint64)])
        kind = np.float64 if words else np.float32
        lp, rest = (np.concatenate([*(np.frombuffer(free(row[c]), kind) for row in own if row[c]), np.zeros(1)]) for c in ("lp", "rest"))
        for row in asked.to_pylist():
            name, rid, n = unsteps(free(row["name"])), unplanes(free(row["rid"]), np.int32), unplanes(free(row["n"]), np.int32)
            at = np.searchsorted(keys[:-1], name)
            known = np.flatnonzero(keys[at] == name)
            at, some, times, size = at[known], rid[known], n[known], int(rid.max()) + 1
            by_doc = [np.bincount(some, rest[at] * times, size)]
            if words:
                by_doc = [np.bincount(some, lp[at] * times, size), np.bincount(rid, n, size) - np.bincount(some, times, size), *by_doc]
            met = np.flatnonzero(np.any(by_doc, axis=0)).astype(np.int32)
            cells = [press(planes(x[met].astype(np.float32))) for x in by_doc]
            rows.append((row["block"], press(planes(met)), *([] if words else [None, None]), *cells))
        return trimmed(_rows(rows, SUMS))

    return run


def _totals(rows: pa.Table) -> pa.Table:
    """One row of a block's answers, in doubles."""
    free, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    total = np.zeros((3, 0))
    for row in rows.to_pylist():
        rid = unplanes(free(row["rid"]), np.int32)  # each once in a cell
        if len(rid) and rid[-1] >= total.shape[1]:
            total = np.pad(total, ((0, 0), (0, int(rid[-1]) + 1 - total.shape[1])))
        for k, part in enumerate(("lp", "unknown", "rest")):
            if row[part] is not None:
                total[k, rid] += unplanes(free(row[part]), np.float32)
    rid = np.arange(total.shape[1], dtype=np.int32)
    return trimmed(_rows([(rows.column("block")[0].as_py(), press(planes(rid)), *(press(planes(x)) for x in total))], SUMS))


def _parts(texts: DataFrame, turns: int) -> list[Column]:
    """Conditions that deal the packed rows to turns, about evenly and by whole blocks."""
    cuts = texts.agg(F.percentile_approx("block", [k / turns for k in range(1, turns)], 10_000)).first()[0] if turns > 1 else None
    edges = sorted(set(cuts or []))
    after = [F.lit(True), *(F.col("block") > x for x in edges)]
    return [a & b for a, b in zip(after, [*(F.col("block") <= x for x in edges), F.lit(True)], strict=True)]


def word_sums(texts: DataFrame, flags: DataFrame, size: int, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sums, langs).

    texts: packed blocks of doc_id, fp, rid, lang, text; flags: block, rid of the documents to train on; size: bytes of all
    texts.  sums: SUMS, one row a block: for documents of that block, the sum of ln p1 of known words, the
    number of unknown ones, and the sum of the other terms of ln p, as doubles.  langs: lang, unknown (ln p1 of an unknown word).
    """
    spark = texts.sparkSession
    bits = min(64, SPARE_BITS + max(1, math.ceil(math.log2(size + 2))))
    turns = int(max(min(TURNS, 1 + size // TURN_BYTES), 1 + texts.count() // TURN_ROWS))
    shards = turns * -(-max(partitions(spark), size // WORD_BYTES // SHARD_WORDS) // turns)
    by_word = turns * -(-shards // (2 * turns))
    counted = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_count(by_word, bits), _TYPES_SQL)
    types = store.put(counted.groupBy("shard").applyInArrow(lambda rows: trimmed(_merge(rows)), _TYPES_SQL), "types")
    follow = store.put(types.mapInArrow(_followed, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "follow")
    ones = follow.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"m{k}") for k in (1, 2, 3, 4)], F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count_if(F.col("n") >= 3).alias("m3up"))
    pairs = types.mapInArrow(_counts_of_counts, "lang string, n1 long, n2 long, n3 long, n4 long").groupBy("lang").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4)])
    langs = ones.join(pairs, "lang").select("*", *[discount("m", k).alias(f"a{k}") for k in (1, 2, 3)], *[discount("n", k).alias(f"b{k}") for k in (1, 2, 3)])
    # what the lowest order leaves goes evenly to all its words and the unknown one
    langs = langs.withColumn("even", (F.col("m1") * F.col("a1") + F.col("m2") * F.col("a2") + F.col("m3up") * F.col("a3")) / F.col("total") / (F.col("kinds") + 1))
    langs = store.put(langs.select("lang", "total", "even", "a1", "a2", "a3", "b1", "b2", "b3", F.ln("even").alias("unknown")), "langs")
    cut = F.when(F.col("n") == 1, F.col("a1")).when(F.col("n") == 2, F.col("a2")).otherwise(F.col("a3"))
    p1 = follow.join(small(langs, 100), "lang").select(F.col("w").alias("key"), F.ln((F.col("n") - cut) / F.col("total") + F.col("even")).alias("lp"))
    p1 = store.put(p1, "lowest")
    known = types.join(small(langs, 100), "lang")
    left = known.mapInArrow(_contexts, "key long, lg double")
    both = p1.select("key", "lp", F.lit(0.0).alias("lg")).unionByName(left.select("key", F.lit(0.0).alias("lp"), "lg"))
    words = store.put(both.groupBy("key").agg(F.sum("lp").alias("lp"), F.sum("lg").alias("lg")), "words")
    # names rise with shards as unsigned numbers do
    its_shard = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(by_word), 32).cast("int")
    own = words.select((F.lit(shards) + its_shard).cast("int").alias("shard"), "key", "lp", "lg")
    buckets = min(100_000, partitions(spark))
    model = store.put_by(own.groupBy("shard").applyInArrow(lambda rows: _word_model(rows), _MODEL_SQL), "shard", buckets, "model", deal=False)
    store.drop(follow, words)
    for turn in range(turns):
        dealt = known.mapInArrow(_ratios(by_word, shards, bits, turn, turns), _PAIRS_SQL)
        terms = dealt.groupBy("shard").cogroup(p1.select("key", "lp", its_shard.alias("shard")).groupBy("shard")).applyInArrow(_pair_terms(shards), _TERMS_SQL)
        model = store.put_by(terms.groupBy("shard").applyInArrow(lambda rows: _pair_model(rows), _MODEL_SQL), "shard", buckets, "model", deal=False, onto=model)
    store.drop(types, p1)
    sums = []
    for part in _parts(texts, turns):
        asked = texts.where(part).mapInArrow(_ask(by_word, shards, bits), _ASKED_SQL)
        answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_sums(shards), SUMS_SQL)
        sums.append(store.put(answers.groupBy("block").applyInArrow(lambda rows: _totals(rows), SUMS_SQL), "sums"))
    store.drop(model)
    out = sums[0]
    for more in sums[1:]:
        out = out.unionByName(more)
    return out, langs.select("lang", "unknown")
