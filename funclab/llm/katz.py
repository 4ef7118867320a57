"""Katz backoff over word pairs: Good-Turing discounted counts, exactly normalised backoff weights.

Texts are read once, into blocks of documents whose tokens are numbers of the block's own word
list. A block then asks for what it needs instead of carrying every token through a shuffle: its
distinct words go to word buckets and come back with count and identifier; its distinct pairs go
to buckets of their first word and come back with the pair's count and with the sums that give
that word's backoff weight. Buckets are the tables of the model. A very frequent first word is
spread over several buckets by its second word, and its sums are added up.

The probability of a token after a word is the discounted share of the pair if it was seen, else
the word's backoff weight times the probability of the token alone; that is the discounted share
of a word that was seen, or what discounting has left for words never seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import new_name, scratch_path, store_at, worker_store

#: Tokens of a block, about, and of what one bucket gathers.
BLOCK = 1_500_000
BUCKET = 1_000_000
#: Words kept with their hash by a worker.
KEPT = 300_000
#: Counts up to this one are discounted.
SMALL = 5
#: A first word seen this often, or in one of 100,000 tokens, is spread over buckets.
HOT, HOT_SHARE = 2_000_000, 100_000
_END, _START = -1, -2
_BLOCKS = "block long, n_train long, n_words long, doc_ids array<long>, held array<boolean>, train array<boolean>, lengths array<int>, words binary, counts binary, seq binary"
_WORDS = "kind string, bucket long, block long, a binary, b binary, n long, v long, hist array<long>"
_PAIRS = "kind string, bucket long, block long, a binary, b binary, hist array<long>, h array<long>, sums array<double>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _squeeze(array, kind) -> bytes:
    """An array as bytes, grouped by significance and compressed."""
    import zstandard

    raw = np.ascontiguousarray(array, kind)
    return zstandard.compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes(), 1) if len(raw) else b""


def _spread(data, kind) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def mixed(x) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)


def discounts(hist) -> np.ndarray:
    """Factor for counts 0 .. SMALL, and 1 where the counts of counts give none between 0 and 1.

    ``hist[r]`` is how many n-grams were seen r times, up to SMALL + 1.
    """
    d = np.ones(SMALL + 1)
    if hist[1] > 0:
        over = (SMALL + 1) * hist[SMALL + 1] / hist[1]
        for r in range(1, SMALL + 1):
            if hist[r] > 0 and over < 1:
                x = ((r + 1) * hist[r + 1] / (r * hist[r]) - over) / (1 - over)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


def discounted(counts, d):
    return counts * np.where(counts <= SMALL, d[np.minimum(counts, SMALL)], 1.0)


class Words:
    """Probability of a word alone. ``unknown`` is what is left for all words never seen."""

    def __init__(self, n, v, hist):
        self.n, self.v, self.d = n, v, discounts(hist)
        kept = n - sum((1 - self.d[r]) * r * hist[r] for r in range(1, SMALL + 1))
        self.over = n if kept < n - 1e-9 else n + 1  # where nothing is discounted, one more token is taken as seen
        self.unknown = 1 - kept / self.over if n else 1.0

    def of(self, counts):
        counts = np.asarray(counts, np.int64)
        return np.where(counts > 0, discounted(counts, self.d) / max(self.over, 1), self.unknown)

    def base(self, counts):
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))


def backoff(small, seen_share, own, d):
    """Weight of unseen followers, and the divisor of seen ones, from sums over seen followers.

    ``small[:, r - 1]`` counts followers seen r times, ``own`` is how often the word was followed,
    ``seen_share`` the probability that its seen followers have alone. A word never followed has
    weight 1; one whose followers lose nothing to discounts is taken to be followed once more.
    """
    lost = (small * (np.arange(1, SMALL + 1) * (1 - d[1:]))).sum(axis=1)
    over = np.where(lost > 1e-9, own, own + 1)
    left = np.where(lost > 1e-9, lost, 1) / np.maximum(over, 1)
    return np.where(own > 0, left / np.maximum(1 - seen_share, 1e-12), 1.0), np.maximum(over, 1)


class _Hashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 2  # the marks of end and start stay free
        return h


def word_hashes() -> _Hashes:
    """The worker's hashes of words."""
    return worker_store("words").setdefault("hashes", _Hashes())


def _blocks(size):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32())] + [pa.binary()] * 3
        hashes = word_hashes()
        part, made = TaskContext.get().partitionId(), 0

        def block(docs):
            lengths = np.array([len(d[3]) for d in docs])
            words, seq = np.unique(np.concatenate([d[3] for d in docs]), return_inverse=True)
            counts = np.bincount(seq[np.repeat([d[2] for d in docs], lengths)], minlength=len(words))
            row = (
                (part << 32) | made, int(counts.sum()), len(words), [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs],
                lengths, words.tobytes(), _squeeze(counts, np.uint32), _squeeze(seq, np.uint32),
            )
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        docs, held = [], 0
        for b in batches:
            for doc_id, out, train, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                found = tokens(text.as_py())
                docs.append((doc_id, out, train, np.fromiter((hashes[w] for w in found), np.uint64, len(found))))
                docs[-1] = (*docs[-1][:3], np.append(docs[-1][3], np.array([_END], np.int64).view(np.uint64)))
                held += len(docs[-1][3])
                if held >= size:
                    yield block(docs)
                    docs, held, made = [], 0, made + 1
        if docs:
            yield block(docs)

    return run


def _ask_words(bits):
    """A block's words for each bucket, which is the first bits of their hash."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for block, words, counts in zip(*(c.to_pylist() for c in b.columns)):
                words, counts = np.frombuffer(words, np.uint64), _spread(counts, np.uint32)
                cuts = np.searchsorted(words >> np.uint64(64 - bits) if bits else np.zeros(len(words), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
                rows = [(k, block, words[i:j].tobytes(), _squeeze(counts[i:j], np.uint32)) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "block", "words", "counts"])

    return run


def _count_words(bits):
    def run(key, table):
        import pandas as pd

        asked = [np.frombuffer(w, np.uint64) for w in table["words"]]
        all_, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, np.concatenate([_spread(c, np.uint32) for c in table["counts"]]), len(all_)).astype(np.int64)
        names, start = (np.arange(len(all_), dtype=np.uint64) << np.uint64(bits)) | np.uint64(key[0]), 0
        out = []
        for block, words in zip(table["block"], asked):
            mine = at[start : start + len(words)]
            out.append(("reply", key[0], block, _squeeze(counts[mine], np.uint64), _squeeze(names[mine], np.uint64), 0, 0, None))
            start += len(words)
        hist = np.bincount(np.minimum(counts, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2]
        out.append(("table", key[0], -1, all_.tobytes(), _squeeze(counts, np.uint64), counts.sum(), (counts > 0).sum(), hist.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _WORDS.split(", ")])

    return run


def _keep_replies(where, kind):
    """One file for a block, with the replies of all buckets in order."""

    def run(key, table):
        import pickle

        import pandas as pd

        store, folder = store_at(where)
        name = f"{kind}-{new_name()}"
        table = table.sort_values("bucket")
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(pickle.dumps([(bytes(a), bytes(b)) for a, b in zip(table["a"], table["b"])]))
        return pd.DataFrame({"block": [key[0]], "file": [name]})

    return run


def _read(where, name):
    import pickle

    store, folder = store_at(where)
    with store.open_input_stream(f"{folder}/{name}") as f:
        return pickle.loads(f.read())


class _Pairs:
    """A block's pairs of neighbouring tokens: the distinct ones, by bucket, first word and second."""

    def __init__(self, where, reply, lengths, seq, model, buckets, hot):
        parts = _read(where, reply)
        self.counts = np.concatenate([_spread(a, np.uint64) for a, _ in parts]).astype(np.int64)
        names = np.concatenate([_spread(b, np.uint64) for _, b in parts])
        self.seq, self.lengths, n = seq, lengths, len(self.counts)
        before = np.empty(len(seq), np.int64)
        before[1:] = seq[:-1]
        before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = n
        pairs, self.at = np.unique(before * (n + 1) + seq, return_inverse=True)
        h, self.w = pairs // (n + 1), pairs % (n + 1)
        # The start of a text is the word after all others; it is followed as often as there are training texts.
        own = np.append(self.counts, model["docs"])
        h_names = np.append(names, np.uint64((1 << 32) - 1))
        self.own, self.h, self.w_name = own[h], h_names[h], names[self.w]
        pieces = 1 + self.own // hot
        sub = (mixed(self.w_name) % pieces.astype(np.uint64)).astype(np.uint64)
        bucket = (mixed(self.h + (sub << np.uint64(33))) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((self.w_name, sub, self.h, bucket))
        self.bucket, self.hot = bucket[self.order], pieces[self.order] > 1
        self.key = (self.h[self.order] << np.uint64(32)) | self.w_name[self.order]
        new = np.ones(len(pairs), bool)
        new[1:] = (self.h[self.order][1:] != self.h[self.order][:-1]) | (self.bucket[1:] != self.bucket[:-1]) | (sub[self.order][1:] != sub[self.order][:-1])
        self.run = np.cumsum(new) - 1  # a run is one first word in one bucket

    def learnt(self, train):
        mask = np.repeat(train, self.lengths)
        return np.bincount(self.at[mask], minlength=len(self.order))[self.order]


def _ask_pairs(where, files, model, buckets, hot):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for block, train, lengths, seq in zip(*(c.to_pylist() for c in b.columns)):
                p = _Pairs(where, files[block], np.array(lengths), _spread(seq, np.uint32).astype(np.int64), model, buckets, hot)
                learnt, w_counts = p.learnt(np.array(train, bool)), p.counts[p.w][p.order]
                ks, cuts = np.unique(p.bucket, return_index=True)
                for k, i, j in zip(ks, cuts, [*cuts[1:], len(p.bucket)]):
                    part = slice(i, j)
                    row = (k, block, _squeeze(np.diff(p.key[part], prepend=np.uint64(0)), np.uint64), _squeeze(learnt[part], np.uint32), _squeeze(w_counts[part], np.uint64), _squeeze(p.run[part] - p.run[i], np.uint32), _squeeze(p.hot[part], np.uint8))
                    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["bucket", "block", "key", "learnt", "w", "run", "hot"])

    return run


def _count_pairs(model):
    words = Words(model["n"], model["v"], model["hist"])

    def run(key, table):
        import pandas as pd

        with np.errstate(over="ignore"):
            asked = [np.cumsum(_spread(k, np.uint64), dtype=np.uint64) for k in table["key"]]
        all_, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        counts = np.bincount(at, np.concatenate([_spread(x, np.uint32) for x in table["learnt"]]), len(all_)).astype(np.int64)
        alone = words.of(np.concatenate([_spread(x, np.uint64) for x in table["w"]])[first])
        hot = np.concatenate([_spread(x, np.uint8) for x in table["hot"]])[first] > 0
        h = all_ >> np.uint64(32)
        names, group = np.unique(h, return_inverse=True)
        small = np.stack([np.bincount(group, counts == r, len(names)) for r in range(1, SMALL + 1)])
        share = np.bincount(group, alone * (counts > 0), len(names))
        out, start = [], 0
        for block, mine, run_ in zip(table["block"], asked, table["run"]):
            pairs = at[start : start + len(mine)]
            start += len(mine)
            runs = group[pairs[np.unique(_spread(run_, np.uint32), return_index=True)[1]]]
            sums = np.concatenate([small[:, runs].ravel(), share[runs].astype(np.float32).view(np.uint32)])
            out.append(("reply", key[0], block, _squeeze(counts[pairs], np.uint64), _squeeze(sums, np.uint32), None, None, None))
        hist = np.bincount(np.minimum(counts, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2]
        seen = counts > 0
        warm = np.unique(group[hot])
        sums = np.vstack([small[:, warm], share[warm]]).T.ravel()
        out.append(("table", key[0], -1, _squeeze(np.diff(all_[seen], prepend=np.uint64(0)), np.uint64), _squeeze(counts[seen], np.uint64), hist.tolist(), names[warm].astype(np.int64).tolist(), sums.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PAIRS.split(", ")])

    return run


def _score(where, word_files, pair_files, model, buckets, hot, held):
    def run(batches):
        import pyarrow as pa

        words, d = Words(model["n"], model["v"], model["hist"]), discounts(model["pair_hist"])
        for b in batches:
            for block, ids, out, lengths, seq in zip(*(c.to_pylist() for c in b.columns)):
                lengths = np.array(lengths)
                p = _Pairs(where, word_files[block], lengths, _spread(seq, np.uint32).astype(np.int64), model, buckets, hot)
                parts = [(_spread(a, np.uint64).astype(np.int64), _spread(x, np.uint32).reshape(SMALL + 1, -1)) for a, x in _read(where, pair_files[block])]
                counts = np.concatenate([a for a, _ in parts])
                sums = np.concatenate([x for _, x in parts], axis=1)
                small, share = sums[:SMALL].T.astype(float), np.ascontiguousarray(sums[SMALL]).view(np.float32).astype(float)
                own, first = p.own[p.order], np.unique(p.run, return_index=True)[1]
                for i in np.flatnonzero(p.hot[first]):  # its sums are spread over buckets
                    s = held.value[int(p.h[p.order][first[i]])]
                    small[i], share[i] = s[:SMALL], s[SMALL]
                weight, over = backoff(small, share, own[first], d)
                alone = words.of(p.counts)
                seen = discounted(counts, d) / over[p.run]
                prob = np.where(counts > 0, seen, weight[p.run] * alone[p.w][p.order])
                logs = np.empty(len(prob))
                logs[p.order] = np.log10(np.maximum(prob, 1e-300))
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                total = np.add.reduceat(logs[p.at], starts)
                base = np.add.reduceat(words.base(p.counts)[p.seq], starts)
                known = np.add.reduceat((p.counts > 0)[p.seq].astype(np.int64), starts)
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                columns = [ids, out, lengths, known, np.full(len(ids), model["n"]), base, total]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _SCORES.split(", ")])

    return run


def score(docs: DataFrame, train, held_out, block=BLOCK, bucket=BUCKET) -> DataFrame:
    """Log10 probabilities of whole texts by the texts for which the column ``train`` is true.

    A null or empty text is the end alone. A null in ``train`` counts as false and in ``held_out``
    too. Repeated rows count and are scored one by one, other columns are not read, and without any
    training text every token is unknown. Identifiers of words take 32 bits.
    """
    spark = docs.sparkSession
    where = scratch_path(spark, "katz")
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), yes(held_out).alias("held"), yes(train).alias("train"), "text")
    rows.mapInArrow(_blocks(block), _BLOCKS).write.parquet(f"{where}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{where}/blocks")
    total, n_docs = blocks.agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size(F.filter("train", lambda x: x)))
    ).first()
    if not total:
        return spark.createDataFrame([], _SCORES)
    store, folder = store_at(where)
    store.create_dir(folder, recursive=True)

    bits = max(0, int(np.ceil(np.log2(total / bucket))))
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask_words(bits), "bucket long, block long, words binary, counts binary")
    asked.groupBy("bucket").applyInPandas(_count_words(bits), _WORDS).write.parquet(f"{where}/words")
    words = spark.read.schema(_WORDS).parquet(f"{where}/words")
    files = lambda t, kind: {  # noqa: E731  a row for each block, which is about a task
        r["block"]: r["file"]
        for r in t.filter("kind = 'reply'").select("block", "bucket", "a", "b").groupBy("block").applyInPandas(_keep_replies(where, kind), "block long, file string").collect()
    }
    word_files = files(words, "words")
    table = words.filter("kind = 'table'")
    slots = [F.sum(F.col("hist")[r]) for r in range(SMALL + 2)]
    n, v, most, *hist = table.agg(F.sum("n"), F.sum("v"), F.max(F.length("a") / 8), *slots).first()
    if int(most) << bits >= (1 << 32) - 1:
        raise ValueError("more distinct words than identifiers of 32 bits")
    model = {"n": n, "v": v, "hist": hist, "docs": n_docs}

    buckets, hot = max(1, -(-total // bucket)), max(HOT, n // HOT_SHARE)
    kinds = "bucket long, block long, key binary, learnt binary, w binary, run binary, hot binary"
    asked = blocks.select("block", "train", "lengths", "seq").mapInArrow(_ask_pairs(where, word_files, model, buckets, hot), kinds)
    asked.groupBy("bucket").applyInPandas(_count_pairs(model), _PAIRS).write.parquet(f"{where}/pairs")
    pairs = spark.read.schema(_PAIRS).parquet(f"{where}/pairs")
    pair_files = files(pairs, "pairs")
    table = pairs.filter("kind = 'table'")
    model["pair_hist"] = list(table.agg(*slots).first())
    warm = table.select(F.posexplode("h").alias("i", "h"), "sums")
    warm = warm.select("h", *(F.expr(f"sums[i * {SMALL + 1} + {r}]").alias(f"s{r}") for r in range(SMALL + 1)))
    # At most HOT_SHARE words are that frequent.
    found = warm.groupBy("h").agg(*(F.sum(f"s{r}") for r in range(SMALL + 1))).collect()
    held = spark.sparkContext.broadcast({r[0]: list(r)[1:] for r in found})
    scored = blocks.select("block", "doc_ids", "held", "lengths", "seq")
    return scored.mapInArrow(_score(where, word_files, pair_files, model, buckets, hot, held), _SCORES)
