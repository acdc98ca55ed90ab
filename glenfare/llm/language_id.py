"""Language ID (operator 5): interpolated Kneser-Ney character models.

For each language an n-gram model of order ``ORDER`` over lower-cased letters
(everything else is one space) is kept in sorted arrays of n-gram hashes, with
the interpolated log-probability of each language beside each hash and the
back-off weight beside each context hash.  A text gets the language whose model
has the lowest cross-entropy for each character; the probability of that choice
is a softmax whose sharpness, like the cross-entropy up to which a text counts
as written in a language at all, is calibrated on texts kept from the counts.

The classifier is fitted on a bounded sample: about ``TRAIN_DOCS`` documents of
each language, taken by hash, which bounds the model's size; it holds every n-gram
of these, so no language loses any to others.  Every row is judged, on its whole text.

Edge cases: null text and text without a letter are ``und`` with score 0 and
not accepted; a table without any labelled row makes every text ``und``; ties go to the
language that sorts first; a null doc_id is learned from; repeated rows each
get their answer; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, small_batches, table

ORDER = 4
#: Bound of the fitted sample.
TRAIN_DOCS = 4000
#: One training document in so many is kept for calibration.
CALIBRATE_ONE_IN = 5
#: Deviations (1.4826 median absolute ones, and the least) above the median up to which a text is accepted.
MARGIN, LEAST_DEVIATION = 6.0, 0.01
#: Calibration texts that a language, or a language's band of lengths, needs for a limit of its own.
OWN_LIMIT = 20
#: Lengths of less than 2^(k + 1) characters are in band k.
BANDS = 16
#: Characters scored at once, with up to four languages (fewer with more).
SLICE = 1 << 19

OTHER = re.compile(r"[\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def hashes(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place from n - 1 on."""
    h = np.zeros(max(0, len(c) - n + 1), np.uint64)
    for i in range(n):
        h = (h ^ c[i:i + len(h)]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def hash_rows(grams: np.ndarray) -> np.ndarray:
    """As ``hashes``, for n-grams given as rows of code points."""
    h = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1]):
        h = (h ^ grams[:, i]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


# ---- fitting -----------------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, train_docs: int) -> DataFrame:
    """(lang, text, calibrate): about ``train_docs`` rows of each language, by hash."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled.select("lang", "text", F.lit(False).alias("calibrate")).limit(0)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007))
    least = F.create_map(*[F.lit(x) for l, n in sizes.items()
                           for x in (l, int(1_000_000_007 * min(1.0, train_docs / n)))])
    return labelled.filter(draw <= least[F.col("lang")]).select(
        "lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE_ONE_IN)) == 0)
        .alias("calibrate"))


def count_grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch."""
    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            s = letters(text or "")
            if s:
                by_lang.setdefault(lang, []).append(" " * (order - 1) + s + " ")
        for lang, texts in by_lang.items():
            joined = "".join(texts)
            for lo in range(0, len(joined), SLICE):  # n-grams over a text's end start with its padding: harmless
                part = joined[lo:lo + SLICE + order - 1]
                h = hashes(codes(part), order)
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(
                    [part[i:i + order] for i in at.tolist()], pa.string()), "n": pa.array(n, pa.int64())})


def kneser_ney(grams: np.ndarray, n: np.ndarray, n_chars: int) -> list[dict]:
    """One language's model from its highest-order n-grams and their counts: for
    each order (1 first) the hashes, probabilities and back-off weights.  Lower
    orders count the distinct characters to the left."""
    levels = []
    while grams.shape[1]:
        levels.insert(0, (grams, n))
        lower = grams[:, 1:]
        if not lower.shape[1]:
            break
        _, at, left = np.unique(hash_rows(lower), return_index=True, return_counts=True)
        grams, n = lower[at], left
    model, below = [], {}
    for k, (g, n) in enumerate(levels, 1):
        n1, n2 = int((n == 1).sum()), int((n == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = hash_rows(g[:, :-1])
        ctx, which, followers = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(which, weights=n)
        backoff = d * followers / total
        if k == 1:
            low = np.full(len(g), 1.0 / n_chars)
        else:
            at = np.searchsorted(below["keys"], hash_rows(g[:, 1:]))
            low = below["p"][at]
        p = np.maximum(n - d, 0) / total[which] + backoff[which] * low
        keys = hash_rows(g)
        order = np.argsort(keys)
        below = {"keys": keys[order], "p": p[order], "grams": g[order], "ctx": ctx, "backoff": backoff}
        model.append(below)
    return model


def joined_model(by_lang: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """All languages' models in common sorted hash arrays: ``keys[k]`` with
    ``logp[k][:, language]``, ``ctx[k]`` with ``logb[k][:, language]``."""
    langs = sorted(by_lang)
    chars = np.unique(np.concatenate([g.ravel() for g, _ in by_lang.values()]))
    models = [kneser_ney(*by_lang[l], len(chars) + 1) for l in langs]
    out = {"langs": langs, "order": len(models[0]), "keys": [], "logp": [], "ctx": [], "logb": [],
           "floor": float(-np.log(len(chars) + 1))}
    for k in range(out["order"]):
        ctx = np.unique(np.concatenate([m[k]["ctx"] for m in models]))
        logb = np.zeros((len(ctx), len(langs)))
        for j, m in enumerate(models):
            logb[np.searchsorted(ctx, m[k]["ctx"]), j] = np.log(m[k]["backoff"])
        out["ctx"].append(ctx)
        out["logb"].append(logb.astype(np.float32))
        every = np.concatenate([m[k]["grams"] for m in models])
        keys, at = np.unique(hash_rows(every), return_index=True)
        grams = every[at]
        logp = backed_off(out, grams, k) if k else np.broadcast_to(
            out["floor"] + out["logb"][0][0], (len(keys), len(langs)))
        logp = np.array(logp, np.float32)
        for j, m in enumerate(models):
            logp[np.searchsorted(keys, m[k]["keys"]), j] = np.log(m[k]["p"])
        out["keys"].append(keys)
        out["logp"].append(logp)
    return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def backed_off(model: dict, grams: np.ndarray, k: int) -> np.ndarray:
    """Log-probabilities, by language, of n-grams of order k + 1 that order k + 1 does not hold."""
    at, hit = found(model["ctx"][k], hash_rows(grams[:, :-1]))
    return np.where(hit[:, None], model["logb"][k][at], 0) + log_probabilities(model, grams[:, 1:], k - 1)


def log_probabilities(model: dict, grams: np.ndarray, k: int) -> np.ndarray:
    """Log-probability of each n-gram's last character, by language."""
    at, hit = found(model["keys"][k], hash_rows(grams))
    out = model["logp"][k][at]
    miss = np.flatnonzero(~hit)
    if len(miss):
        out[miss] = backed_off(model, grams[miss], k) if k else model["floor"] + model["logb"][0][0]
    return out


# ---- scoring -----------------------------------------------------------------------------------

def entropies(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each text by language, and its characters (0: no letter)."""
    order, pad = model["order"], " " * (model["order"] - 1)
    total, size = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    held = 0
    at_once = SLICE if len(model["langs"]) <= 4 else max(1 << 12, 4 * SLICE // len(model["langs"]))

    def score() -> None:
        nonlocal parts, owner, held
        if not parts:
            return
        c = codes("".join(parts))
        h = hashes(c, order)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        first = ends - lengths  # the n-grams of a part start from its first character
        at, hit = found(model["keys"][-1], h)
        logp = model["logp"][-1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            grams = np.stack([c[miss + i] for i in range(order)], axis=1)
            logp[miss] = backed_off(model, grams, order - 1)
        run = np.vstack([np.zeros((1, logp.shape[1])), np.cumsum(logp, axis=0, dtype=np.float64)])
        sums = run[np.maximum(ends - (order - 1), first)] - run[first]
        np.add.at(total, owner, sums)
        np.add.at(size, owner, lengths - (order - 1))
        parts, owner, held = [], [], 0

    for i, text in enumerate(texts):
        s = letters(text or "")
        if not any(ch.isalpha() for ch in s):
            continue
        s = pad + s + " "
        for lo in range(0, len(s) - order + 1, at_once):  # a long text in slices that share their context
            piece = s[lo:lo + at_once + order - 1]
            parts.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= at_once:
                score()
    score()
    return -total / np.maximum(size, 1)[:, None], size


def calibration_rows(batches, model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, n = entropies(model.value, b.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"lang": b.column("lang").cast(pa.string()), "n": pa.array(n, pa.int64()),
                                          "h": pa.array(h.tolist(), pa.list_(pa.float64()))})


def softmax(h: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    z = -h * sharpness * np.sqrt(np.maximum(n, 1))[:, None]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def band(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), BANDS - 1)


def robust(x: np.ndarray) -> tuple[float, float]:
    """Median and deviation, which odd values hardly move."""
    middle = float(np.median(x))
    return middle, max(LEAST_DEVIATION, 1.4826 * float(np.median(np.abs(x - middle))))


def limits(true: np.ndarray, n: np.ndarray, h: np.ndarray, n_langs: int, uniform: float) -> np.ndarray:
    """The cross-entropy up to which a text is accepted, by language and band of lengths.

    It is MARGIN deviations above the median of the language's calibration texts in that band.
    A band with too few takes the deviations from each language's median of all languages' texts in it
    or, with too few again, in the nearest band that has enough, on top of the language's median (the mean of a text half
    as long deviates 2^0.5 times as much); a language with too few takes the greater of its own and the common median.  No limit is above that of letters drawn
    evenly, which is all there is without enough texts of any language."""
    out = np.full((n_langs, BANDS), uniform)
    if len(h) < OWN_LIMIT:
        return out
    common = float(np.median(h))
    counts = np.bincount(true, minlength=n_langs)
    center = np.array([np.median(h[true == j]) if counts[j] else common for j in range(n_langs)])
    center = np.where(counts < OWN_LIMIT, np.maximum(center, common), center)
    at, off = band(n), h - center[true]
    enough = np.flatnonzero(np.bincount(at, minlength=BANDS) >= OWN_LIMIT)
    for k in range(BANDS):
        nearest = enough[np.abs(enough - k).argmin()] if len(enough) else int(np.median(at))
        middle, deviation = robust(off[at == nearest] if len(enough) else off)
        deviation *= 2 ** (max(0, nearest - k) / 2)
        out[:, k] = center + middle + MARGIN * deviation
        for j in range(n_langs):
            own = h[(true == j) & (at == k)]
            if len(own) >= OWN_LIMIT:
                middle_j, deviation_j = robust(own)
                out[j, k] = middle_j + MARGIN * deviation_j
    return np.minimum(out, uniform)


def calibrate(model: dict, lang: np.ndarray, n: np.ndarray, h: np.ndarray) -> dict:
    """Add ``sharpness`` of the softmax, by the likelihood of the true languages,
    and ``limit``, the cross-entropy up to which a text is accepted."""
    langs = model["langs"]
    ok = (n > 0) & np.isin(lang, langs)
    lang, n, h = lang[ok], n[ok], h[ok]
    true = np.searchsorted(langs, lang)
    grid = [0.1, 0.2, 0.5, 1.0, 2.0, 5.0]
    loss = [-np.log(softmax(h, n, s)[np.arange(len(h)), true] + 1e-12).mean() if len(h) else 0 for s in grid]
    return model | {"sharpness": grid[int(np.argmin(loss))],
                    "limit": limits(true, n, h[np.arange(len(h)), true], len(langs), -model["floor"])}


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER) -> dict | None:
    """The calibrated model (None without labelled rows)."""
    ship(__name__)
    spark = docs.sparkSession
    small_batches(spark)
    sample = training_sample(docs, train_docs)
    grams = (sample.filter("NOT calibrate").select("lang", "text")
             .mapInArrow(partial(count_grams, order=order), "lang string, gram string, n bigint")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if grams.empty:
        return None
    by_lang = {}
    for lang, g in grams.groupby("lang"):
        by_lang[lang] = (codes("".join(g["gram"])).reshape(-1, order), g["n"].to_numpy())
    model = joined_model(by_lang)
    sent = spark.sparkContext.broadcast(model)
    rows = (sample.filter("calibrate").select("lang", "text")
            .mapInArrow(partial(calibration_rows, model=sent), "lang string, n bigint, h array<double>").collect())
    sent.unpersist()
    return calibrate(model, np.array([r["lang"] for r in rows], object).astype(str), np.array([r["n"] for r in rows]),
                     np.array([r["h"] for r in rows]).reshape(-1, len(model["langs"])))


def accepted(m: dict, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    best = h.argmin(axis=1)
    return h[np.arange(len(h)), best] <= m["limit"][best, band(n)]


def predict_rows(batches, model) -> Iterator[pa.RecordBatch]:
    m = model.value
    langs = np.array([*m["langs"], "und"], object)
    for b in batches:
        h, n = entropies(m, b.column("text").to_pylist())
        best = h.argmin(axis=1)
        score = softmax(h, n, m["sharpness"])[np.arange(len(h)), best]
        low = h[np.arange(len(h)), best]
        none = n == 0
        ok = accepted(m, h, n) & ~none
        best[none], score[none], low[none] = len(langs) - 1, 0.0, np.nan
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(langs[best], pa.string()),
            "score": pa.array(score, pa.float64()), "accepted": pa.array(ok, pa.bool_()),
            "cross_entropy": pa.array(low, pa.float64(), from_pandas=True)})


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean, cross_entropy double"


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted and cross_entropy of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("cross_entropy"))
    ship(__name__)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(predict_rows, model=sent), PREDICTED)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def accept_rows(batches, model) -> Iterator[pa.RecordBatch]:
    """The rows whose text is accepted as written in a learned language."""
    m = model.value
    for b in batches:
        h, n = entropies(m, b.column("text").cast(pa.string()).to_pylist())
        yield b.filter(pa.array((n > 0) & accepted(m, h, n)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected (without any labelled row, all)."""
    model = fit(docs)
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(accept_rows, model=docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


QUERIES = {"op5_language_id": op5_language_id}
