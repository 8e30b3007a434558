"""Language identification by hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventide.llm import blocks
from eventide.session import stage_table

_LETTERS = 1024
_state: dict = {}


def _alphabet() -> np.ndarray:
    """Letter number of each code point, upper and lower case alike; 0 for what is no letter. Code
    points beyond Latin share numbers by remainder."""
    if "map" not in _state:
        number = np.zeros(0x110000, np.int16)
        for cp in range(0x40000):  # beyond lie no letters, only unassigned and private code points
            c = chr(cp)
            if c.isalpha():
                low = c.lower()[0]
                number[cp] = 1 + (ord(low) if ord(low) < 0x250 else 0x250 + ord(low) % (_LETTERS - 0x251))
        _state["map"] = number
    return _state["map"]


def _letters(dim: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2, (_LETTERS + 1, dim)).astype(np.float32) * 2 - 1


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: text number, code, count; and the letters of each text. A run of
    other characters is one gap, and every text begins and ends with one."""
    number = _alphabet()
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    x = number[points].astype(np.int64)
    keep = (x > 0) | np.concatenate([[True], x[:-1] > 0])
    keep[np.cumsum(sizes) - sizes] = True
    x, row = x[keep], row[keep]
    count = np.bincount(row[x > 0], minlength=len(texts))
    m = max(0, len(x) - n + 1)
    code = np.zeros(m, np.int64)
    for k in range(n):
        code = code * (_LETTERS + 1) + x[k : k + m]
    same = row[:m] == row[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
    code, r = code[same], row[:m][same]
    base = (_LETTERS + 1) ** n
    key, many = np.unique(r * base + code, return_counts=True)
    return key // base, key % base, many, count


def _vectors(codes: np.ndarray, n: int, letters: np.ndarray) -> np.ndarray:
    """Vector of each n-gram: the product of its letters' vectors, each turned by its place."""
    out = np.ones((len(codes), letters.shape[1]), np.float32)
    for k in range(n):
        out *= np.roll(letters, k, axis=1)[codes % (_LETTERS + 1)]
        codes = codes // (_LETTERS + 1)
    return out


def _bundles(texts: list[str], n: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the n-gram vectors of each text, and its letters."""
    row, code, many, count = _grams(texts, n)
    out = np.zeros((len(texts), letters.shape[1]), np.float32)
    kinds, place = np.unique(code, return_inverse=True)
    for lo in range(0, len(kinds), 4096):
        hi = min(len(kinds), lo + 4096)
        vectors = _vectors(kinds[lo:hi], n, letters)
        here = (place >= lo) & (place < hi)
        dense = np.zeros((len(texts), hi - lo), np.float32)
        dense[row[here], place[here] - lo] = many[here]
        out += dense @ vectors
    return out, count


def _blocks(batch: pa.RecordBatch, limit: int = 1 << 19, most: int = 128) -> Iterator[tuple[int, int, list[str]]]:
    offs, _ = blocks.buffers(batch.column("t"))
    for lo, hi in blocks.row_blocks(offs, limit):
        for a in range(lo, hi, most):
            b = min(hi, a + most)
            yield a, b, batch.column("t").slice(a, b - a).to_pylist()


def _profiles(n: int, dim: int):
    """Sums of the documents' unit vectors per language, one row per task and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letters(dim), {}
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for a, b, texts in _blocks(batch):
                out, count = _bundles(texts, n, letters)
                size = np.linalg.norm(out, axis=1)
                for k in range(b - a):
                    if count[k] and size[k] > 0:
                        sums.setdefault(lang[a + k], np.zeros(dim))
                        sums[lang[a + k]] += out[k] / size[k]
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = 3, dim: int = 1024) -> dict:
    """Language prototypes from all rows with a language: one vector of ``dim`` per language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"))
    parts = rows.mapInArrow(_profiles(n, dim), "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    table = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    learned = {r.lang: np.array(r.v) for r in table.collect()}  # one row per language
    names = sorted(learned)
    mean = sum((learned[k] / np.linalg.norm(learned[k]) for k in names), np.zeros(dim)) / max(1, len(names))
    own = [learned[k] / np.linalg.norm(learned[k]) - mean * (len(names) > 1) for k in names]
    whole = np.array([learned[k] / np.linalg.norm(learned[k]) for k in names]).reshape(len(names), dim)
    return {"whole": whole, "names": names, "n": n, "dim": dim, "mean": mean if len(names) > 1 else mean * 0, "vectors": np.array([v / max(np.linalg.norm(v), 1e-12) for v in own]).reshape(len(names), dim)}


def _predict(model, likeness: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        letters = _letters(m["dim"])
        names = np.array([*m["names"], "und"], object)
        for batch in batches:
            pred, score, alike = [], [], []
            for a, b, texts in _blocks(batch):
                out, count = _bundles(texts, m["n"], letters)
                size = np.linalg.norm(out, axis=1)
                known = (count > 0) & (size > 0) & bool(m["names"])
                x = out / np.maximum(size, 1e-12)[:, None] - m["mean"]
                x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                if m["names"]:
                    cos = np.round(x @ m["vectors"].T, 9)  # the last digits depend on how many texts share a product
                    best = np.argmax(cos, axis=1)
                    top = cos[np.arange(b - a), best]
                else:
                    best, top = np.zeros(b - a, int), np.zeros(b - a)
                pred += names[np.where(known, best, len(m["names"]))].tolist()
                if likeness:
                    own = (out * m["whole"][best]).sum(axis=1) if m["names"] else top
                    alike += zip((own / np.maximum(count, 1)).tolist(), np.where(known, count, 0).tolist(), strict=True)
                score += np.where(known, np.clip((1 + top) / 2, 0, 1), 0.0).tolist()
            others = [batch.column(c) for c in batch.schema.names if c != "t"]
            found = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}
            if likeness:
                found |= {"alike": pa.array([x for x, _ in alike], pa.float64()), "letters": pa.array([n for _, n in alike], pa.int64())}
            yield pa.RecordBatch.from_arrays([*others, *found.values()], [*(c for c in batch.schema.names if c != "t"), *found])

    return run


def held_out(key: Column | str) -> Column:
    """Rows kept from learning: CRC-32 of the key as text, remainder 2 of 4. A null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_id(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Predicts each row's language from its whole text: ``key``, lang_pred, score.

    Each letter has a random sign vector. An n-gram's vector binds (multiplies) its letters' vectors,
    each turned by its place; a text's vector bundles (adds) those of all its n-grams. The answer is
    the prototype of the greatest cosine, once the mean of all prototypes is taken off both; score is
    (1 + cosine) / 2.

    A text that is null or has no letter, and any text under a model of no language, gets `und` and
    score 0. Of equal cosines the first name in order wins. Null and repeated keys keep their rows. An
    empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def known_language(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = 0.6) -> DataFrame:
    """Whether each row's text is in a language of the model: ``key``, lang_pred, known.

    A text's likeness is the mean product of its n-grams with the prototype of its language, the mean not
    taken off. It does not depend on the text's length, only its spread does, which falls with the root of
    its letters. Median and spread of each language come from all rows with that language, one row per language for
    the driver. A text is known if it reaches ``share`` of the median, two deviations allowed; one without a letter is not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    found = stage_table(rows.mapInArrow(_predict(shared, True), f"k {kind}, lang string, lang_pred string, score double, alike double, letters long"), "likeness")
    right = found.where("lang = lang_pred and letters > 0")

    def of_language(values: dict) -> Column:
        """A number of the predicted language: the model has one row per language, and so has this map."""
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        return F.element_at(F.create_map(*pairs).cast("map<string,double>"), F.col("lang_pred")) if pairs else F.lit(None).cast("double")

    middle = {r.lang_pred: r.x for r in right.groupBy("lang_pred").agg(F.percentile_approx("alike", 0.5, 10000).alias("x")).collect()}
    off = F.abs(F.col("alike") - of_language(middle)) * F.sqrt("letters")
    spread = {r.lang_pred: 1.4826 * r.x for r in right.groupBy("lang_pred").agg(F.percentile_approx(off, 0.5, 10000).alias("x")).collect()}
    enough = F.col("alike") + 2 * of_language(spread) / F.sqrt(F.greatest("letters", F.lit(1))) >= share * of_language(middle)
    return found.select(F.col("k").alias(key), "lang_pred", ((F.col("letters") > 0) & F.coalesce(enough, F.lit(False))).alias("known"))
