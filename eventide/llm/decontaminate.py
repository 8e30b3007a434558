"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.llm import blocks
from eventide.session import stage_table

#: Passages by the length of the item they are sought for: up to so many words (none: any), passage, and step from one to the next.
_SCALES = ((9, 16, 8), (None, 32, 16))
_LEAST_WORDS = 5
#: Least share of an item's passage that a space must keep to search for it.
_RENDERED = 0.05


class _Tokens(blocks.Words):
    """Lower-cased words between white space and ASCII punctuation."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        gap = np.zeros(256, bool)
        gap[[c for c in range(128) if not chr(c).isalnum()]] = True
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        super().__init__(data, offs, gap)


def _words(text: str) -> list[int]:
    data = np.frombuffer((text or "").encode() + b"\n", np.uint8)
    return _Tokens(data, np.array([0, len(data)])).ids(0).tolist()


def _blocks(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[tuple[int, _Tokens]]:
    offs, data = blocks.buffers(batch.column("t"))
    for lo, hi in blocks.row_blocks(offs, limit):
        yield lo, _Tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _look_up(vocabulary: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each identifier in the sorted vocabulary; its length if it is not there."""
    at = np.searchsorted(vocabulary, ids)
    return np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == ids, at, len(vocabulary))


def _frequencies(vocabulary):
    """Rows that hold each word of the vocabulary, and all rows (under the number after the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        total = np.zeros(len(v) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, words in _blocks(batch):
                place = _look_up(v, words.ids(0))
                key = np.unique((words.row * (len(v) + 1) + place)[place < len(v)])
                total[:-1] += np.bincount(key % (len(v) + 1), minlength=len(v))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"w": pa.array(at, pa.int64()), "n": pa.array(total[at])})

    return run


def _sketch_rows(idf: np.ndarray, basis):
    """Sums of a'(a B) over the TF-IDF passages a of a task: one row per word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        total = np.zeros_like(b)
        for batch in batches:
            for words in batch.column("words").to_pylist():
                w, n = np.unique(np.array(words, np.int64), return_counts=True)
                x = n * idf[w]
                x /= max(np.linalg.norm(x), 1e-12)
                total[w] += x[:, None] * (x @ b[w])[None, :]
        at = np.flatnonzero(np.abs(total).any(axis=1))
        yield pa.RecordBatch.from_pydict({"w": pa.array(at, pa.int64()), "x": pa.array(total[at].tolist(), pa.list_(pa.float64()))})

    return run


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int, energy: float, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors (words by at most ``rank``) of the TF-IDF passages, by a randomised SVD:
    a random start, then rounds of multiplying with A'A, in which passages stay where they are and
    only sums per word travel. Of the vectors so many are kept as hold ``energy`` of what all passages have."""
    spark = passages.sparkSession
    basis = np.linalg.qr(np.random.default_rng(3).normal(size=(len(idf), min(rank, len(idf)))))[0]

    def product(basis: np.ndarray) -> np.ndarray:
        parts = passages.mapInArrow(_sketch_rows(idf, spark.sparkContext.broadcast(basis)), "w long, x array<double>")
        sums = parts.select("w", F.posexplode("x")).groupBy("w", "pos").agg(F.sum("col").alias("x")).toArrow()  # words of the block by rank
        new = np.zeros_like(basis)
        new[sums["w"].to_numpy(), sums["pos"].to_numpy()] = sums["x"].to_numpy()
        return new

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis) + 1e-9 * basis)[0]
    held, turn = np.linalg.eigh(basis.T @ product(basis))
    order = np.argsort(-held)
    total = passages.count()  # each passage has length 1
    enough = int(np.searchsorted(np.cumsum(held[order]), energy * total)) + 1
    return (basis @ turn[:, order])[:, :enough]


def _pieces(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Passages of an item: ``size`` words, half overlapping, the last one at its end."""
    if len(words) <= size:
        return [words]
    starts = sorted({*range(0, len(words) - size, size // 2), len(words) - size})
    return [words[s : s + size] for s in starts]


def _scale(n: int) -> int:
    """Which of the scales an item of ``n`` words is sought at."""
    return next(k for k, (most, _, _) in enumerate(_SCALES) if most is None or n <= most)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each item, and of its last sentence if it has several."""
    for batch in batches:
        words, answers = [], []
        for text in batch.column("t").to_pylist():
            sentences = [s for s in (text or "").replace("!", ".").replace("?", ".").split(".") if s.strip()]
            words.append(np.array(_words(text), np.uint64).view(np.int64))
            answers.append(np.array(_words(sentences[-1]) if len(sentences) > 1 else [], np.uint64).view(np.int64))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (words, answers)]
        yield pa.RecordBatch.from_arrays([batch.column("i"), *lists], ["i", "words", "answer"])


def _passage_rows(vocabulary):
    """Passages of the items that are long enough, as places in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            out = []
            for words in batch.column("words").to_pylist():
                if len(words) >= _LEAST_WORDS:
                    places = _look_up(v, np.array(words, np.int64).view(np.uint64))
                    out += _pieces(places, _SCALES[_scale(len(words))][1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["words"])

    return run


def common_length(masks: dict[int, int], full: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return (~v & full).bit_count()


def _chunk_sums(table: np.ndarray, place: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over runs of places: the first place of every run, then the second of
    those that have one, and so on. Longer runs stand first, so each step adds to one slice."""
    order = np.argsort(-count, kind="stable")
    start = start[order]
    sums = np.zeros((len(count), table.shape[1]), np.float32)
    for k in range(int(count.max(initial=0))):
        n = int(np.count_nonzero(count > k))
        sums[:n] += table[place[start[:n] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _common_bound(place, lo, hi, item, own_keys, own_counts, width: int, step: int = 4096) -> np.ndarray:
    """For pairs of a region and an item: how many of the item's words occur in the region, in any
    order. No common subsequence is longer."""
    bound = np.zeros(len(lo), np.int64)
    for s in range(0, len(lo), step):
        part = slice(s, s + step)
        reach = hi[part] - lo[part]
        pair = np.repeat(np.arange(len(reach)), reach)
        key = item[part][pair] * width + place[blocks.spans(lo[part], reach)]
        at = np.minimum(np.searchsorted(own_keys, key), len(own_keys) - 1)
        hit = own_keys[at] == key
        both = np.unique(pair[hit] * len(own_keys) + at[hit])
        bound[part] = np.bincount(both // len(own_keys), own_counts[both % len(own_keys)], len(reach))
    return bound


def _passage_scores(words: _Tokens, place: np.ndarray, known: np.ndarray, first: np.ndarray, table: np.ndarray, size: int, step: int):
    """Latent vectors of passages of ``size`` words, one every ``step``: row, first word, vector.

    Chunks of ``step`` words are summed once; a passage is a few chunks in a row. One that only
    ends a longer one is part of the one before."""
    chunks = -(-words.per_row // step)
    inner = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    row = np.repeat(np.arange(len(first)), chunks)
    begin = first[row] + inner * step
    upto = np.concatenate([[0], np.cumsum(known)])
    latent = _chunk_sums(table, place[known], upto[begin], np.diff(np.append(upto[begin], upto[-1])))
    many = size // step
    reach = np.minimum(many, chunks[row] - inner)
    whole = latent.copy()
    for k in range(1, many):
        more = np.flatnonzero(reach > k)
        whole[more] += latent[more + k]
    live = np.flatnonzero((reach == many) | (inner == 0))
    return row[live], begin[live], whole[live]


def _search(model, cosine: float, ratio: float, loose: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        v, items = m["vocabulary"], m["items"]
        lengths = np.array([len(words) for words in items])
        masks = []
        for words in items:
            own: dict[int, int] = {}
            for k, w in enumerate(words):
                own[w] = own.get(w, 0) | 1 << k
            masks.append(own)
        for batch in batches:
            keys = batch.column("k")
            out: list[tuple] = []
            for lo, words in _blocks(batch):
                if not len(words.row):
                    continue
                ids = words.ids(0)
                place = _look_up(v, ids)
                first = np.cumsum(words.per_row) - words.per_row
                known = np.concatenate([[0], np.cumsum(place < len(v))])
                best: dict[tuple[int, int], tuple] = {}
                for scale, spot, table, owners, queries in m["spaces"]:
                    _, size, step = _SCALES[scale]
                    here = np.append(spot, -1)[place]
                    row, begin, whole = _passage_scores(words, here, here >= 0, first, table, size, step)
                    scores = whole @ queries.T
                    scores /= np.maximum(np.linalg.norm(whole, axis=1), 1e-12)[:, None]
                    own = np.flatnonzero(np.diff(owners, prepend=-1))
                    scores = np.maximum.reduceat(scores, own, axis=1)
                    at, which = np.nonzero(scores >= cosine)
                    item, cos = owners[own][which], scores[at, which]
                    r, n = row[at], lengths[item]
                    lo_w = np.maximum(first[r], begin[at] - n)
                    hi_w = np.minimum(first[r] + words.per_row[r], begin[at] + size + n)
                    # No common subsequence is longer than the region's words of the vocabulary.
                    some = known[hi_w] - known[lo_w] >= loose * n - 1e-9
                    at, r, n, item, cos, lo_w, hi_w = (x[some] for x in (at, r, n, item, cos, lo_w, hi_w))
                    near = _common_bound(place, lo_w, hi_w, item, m["own_keys"], m["own_counts"], len(v) + 1) >= loose * n - 1e-9
                    start = begin[at] - first[r]
                    for r, item, n, start, lo_w, hi_w, cos in zip(*(x[near].tolist() for x in (r, item, n, start, lo_w, hi_w, cos)), strict=True):
                        region = ids[lo_w:hi_w].tolist()
                        share = common_length(masks[item], (1 << n) - 1, region) / n
                        if share < loose:
                            continue
                        answer = share < ratio
                        if answer and not _holds(region, m["answers"][item]):
                            continue
                        found = (share, cos, start, answer)
                        if found[:2] > best.get((r, item), (0.0, 0.0))[:2]:
                            best[(r, item)] = found
                for n, (runs, owners) in m["short"].items():
                    here = blocks.window_ids(ids, n)[: len(ids) - n + 1]
                    at = np.flatnonzero(words.whole(n) & np.isin(here, runs))
                    for k in at.tolist():
                        r = int(words.row[k])
                        for item in owners[np.searchsorted(runs, here[k]) : np.searchsorted(runs, here[k], "right")].tolist():
                            best.setdefault((r, item), (1.0, 1.0, int(k - first[r]), False))
                out += [(lo + r, item, *x) for (r, item), x in best.items()]
            if out:
                at, item, share, cos, start, loose_match = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), m["keys"].take(pa.array(item)), pa.array(share), pa.array(cos), pa.array(start, pa.int64()), pa.array(loose_match)],
                    ["k", "item", "share", "cosine", "start_word", "by_answer"],
                )

    return run


def _holds(region: list[int], answer: list[int]) -> bool:
    """Whether the answer stands in the region word by word."""
    n = len(answer)
    return any(region[k] == answer[0] and region[k : k + n] == answer for k in range(len(region) - n + 1)) if n else False


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    rank: int = 160, energy: float = 0.9, cosine: float = 0.35, ratio: float = 0.8, loose: float = 0.6, items_per_block: int = 1000,
) -> DataFrame:
    """Pairs of rows and benchmark items whose text they hold.

    One row per pair: ``key``, ``item``, share (of the item's words, in order), cosine, start_word, by_answer.

    Rows and items are TF-IDF passages over the items' vocabulary (frequencies over all rows): of 32 words, one every
    16, or of 16 words, one every 8, for items of up to nine. The items' passages give a latent space by a distributed
    randomised SVD, of at most ``rank`` dimensions, fewer if they hold ``energy`` of the passages. Items of which it keeps
    too little are dealt, ``rank`` passages at a time, over spaces that their passages span whole, so neither rank nor number of items
    loses one. Both passages are compared within a space, where words that are not the benchmark's hardly count, so a row's passage resembles the item it holds
    whatever part of the item's own length the space keeps. Passages of cosine ``cosine`` or more are candidates. There the longest
    common subsequence with the item is taken: ``ratio`` of its words make a pair; ``loose`` of them do if the
    item's answer, its last sentence, stands there word by word.

    Frequencies take one pass over the rows. Items are searched in blocks of about ``items_per_block``, which bounds what is
    broadcast and what the driver and each task hold, at one pass each. Items of one to four words are sought word for word beside them. Null
    and empty items, and those without a word, match nothing. A null text has no words; a very long one is
    cut into passages like any other, and its words are held at once. Null and repeated keys keep
    their rows; a repeated item gives a pair each. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), blocks.utf8(text, "\n").alias("t"))
    schema = (
        f"k {rows.schema['k'].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}, "
        "share double, cosine double, start_word long, by_answer boolean"
    )
    texts = benchmark.select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t"))
    parsed = texts.mapInArrow(_item_rows, f"i {benchmark.schema[item].dataType.simpleString()}, words array<bigint>, answer array<bigint>")
    parsed = stage_table(parsed.where(F.size("words") > 0).withColumn("n", F.monotonically_increasing_id()), "benchmark-items")
    many = -(-parsed.count() // items_per_block)
    out = spark.createDataFrame([], schema)
    if many:
        vocabulary = np.sort(parsed.select(F.explode("words").alias("w")).distinct().toArrow()["w"].to_numpy().view(np.uint64))
        idf = _idf(rows, vocabulary)
        for block in range(many):
            held = parsed.where(F.pmod(F.xxhash64("n"), F.lit(many)) == block)
            model = _model(held, vocabulary, idf, rank, energy)
            if model is not None:
                out = out.unionByName(rows.mapInArrow(_search(model, cosine, ratio, loose), schema))
    return out.withColumnRenamed("k", key).withColumnRenamed("item", item)


def _idf(rows: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Weight of each word of the benchmark by how many rows hold it."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    count = np.zeros(len(vocabulary) + 1)
    sums = rows.mapInArrow(_frequencies(shared), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    count[sums["w"].to_numpy()] = sums["n"].to_numpy()
    return np.log((count[-1] + 2) / (count[:-1] + 1))


def _few(pieces: list[tuple], left: list[int], most: int) -> list[tuple]:
    """Passages of the first items left, ``most`` at most, one item at least."""
    owned: dict[int, list[tuple]] = {}
    for x in pieces:
        owned.setdefault(x[1], []).append(x)
    out: list[tuple] = []
    for k in left:
        if out and len(out) + len(owned[k]) > most:
            break
        out += owned[k]
    return out


def _model(held: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int, energy: float):
    """Vocabulary, weights, latent basis and query vectors of a block of items, broadcast; None for an empty block."""
    spark = held.sparkSession
    table = held.toArrow()
    if not table.num_rows:
        return None
    items, answers = ([np.array(x, np.int64).view(np.uint64) for x in table[c].to_pylist()] for c in ("words", "answer"))
    own = np.unique(np.concatenate(items))
    idf, vocabulary = idf[_look_up(vocabulary, own)], own
    own_keys, own_counts = np.unique(
        np.concatenate([k * (len(vocabulary) + 1) + _look_up(vocabulary, words) for k, words in enumerate(items)]), return_counts=True
    )
    pieces = [(_scale(len(words)), k, _look_up(vocabulary, p)) for k, words in enumerate(items) if len(words) >= _LEAST_WORDS for p in _pieces(words, _SCALES[_scale(len(words))][1])]
    passages = held.select("words").mapInArrow(_passage_rows(spark.sparkContext.broadcast(vocabulary)), "words array<bigint>")
    passages = stage_table(passages, "benchmark-passages")
    spaces, left = [], sorted({k for _, k, _ in pieces})
    basis = latent_basis(passages, idf, rank, energy) if left else None
    while left:  # the first space holds the items it renders well, the others are dealt over small ones of their own
        whole = basis is not None
        of = [x for x in pieces if x[1] in set(left)] if whole else _few(pieces, left, rank)
        used = np.unique(np.concatenate([p for _, _, p in of]))
        counted = [np.unique(np.searchsorted(used, p), return_counts=True) for _, _, p in of]
        weight = idf[used]
        if whole:
            reach = basis[used]
        else:
            dense = np.zeros((len(used), len(of)))
            for i, (w, n) in enumerate(counted):
                dense[w, i] = n * weight[w]
            reach = np.linalg.qr(dense)[0]
        vectors = np.stack([(n * weight[w]) @ reach[w] for w, n in counted]).astype(np.float32)
        length = np.linalg.norm(vectors, axis=1)
        share = (length / np.maximum([np.linalg.norm(n * weight[w]) for w, n in counted], 1e-12)) ** 2
        shown: dict[int, float] = {}
        for (_, k, _), x in zip(of, share.tolist(), strict=True):
            shown[k] = min(shown.get(k, 1.0), x)
        done = {k for k, x in shown.items() if x >= _RENDERED or not whole}
        spot = np.full(len(idf), -1)
        spot[used] = np.arange(len(used))
        for scale in range(len(_SCALES)):
            at = [i for i, (s, k, _) in enumerate(of) if s == scale and k in done]
            if at:
                unit = vectors[at] / np.maximum(length[at], 1e-12)[:, None]
                spaces.append((scale, spot, (weight[:, None] * reach).astype(np.float32), np.array([of[i][1] for i in at], np.int64), unit))
        left, basis = [k for k in left if k not in done], None
    short = {}
    for n in range(1, _LEAST_WORDS):
        of = [(blocks.window_ids(words, n)[0], k) for k, words in enumerate(items) if len(words) == n]
        if of:
            of.sort()
            short[n] = np.array([x for x, _ in of], np.uint64), np.array([k for _, k in of])
    return spark.sparkContext.broadcast({
        "vocabulary": vocabulary, "items": [w.tolist() for w in items], "answers": [a.tolist() for a in answers], "short": short,
        "keys": table["i"].combine_chunks(), "spaces": spaces, "own_keys": own_keys, "own_counts": own_counts,
    })
