"""Languages of documents as mixtures.

A language is a distribution of hashed pairs and triples of letters, counted over all labelled documents it may be
learnt from. Expectation-maximisation estimates the share of each language in a document from the likelihoods of its
n-grams. Sets of languages are compared by likelihood less a penalty for each language beyond the first, over
the nested sets of the largest shares; the largest share of the best set is the prediction.

Inputs: a text without a letter, a null or an empty one is `und` with score 0; documents without a language are not
learnt from but predicted; without any labelled document all are `und`; repeated rows count as often as they occur;
no column but the text is read for a prediction; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import fresh, map_arrow, slices, texts_of
from .token_counts import LETTER, char_classes

UNKNOWN = "und"
BITS = 13
#: Cells (languages times n-grams) that a model may have, as it is collected and broadcast.
MAX_CELLS = 1 << 23
#: Added to the count of each n-gram.
PRIOR = 0.5
#: Likelihood that a further language must bring: for each n-gram of the document, and by the logarithm of their number.
PENALTY, LOG_PENALTY = 0.03, 4.0
ROUNDS, SLICE, PART = 12, 1 << 20, 1 << 17
#: Score under which `known_only` rejects a document: no language explains it better than chance between several.
LEAST = 0.2
#: How far the log-likelihood of an n-gram may lie below what the chosen languages expect of their own texts: in all, and in standard errors.
SLACK, ERRORS = 1.2, 10.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    letters = np.flatnonzero(char_classes() == LETTER)
    out[letters] = [ord(c) if len(c := chr(p).lower()) == 1 else p for p in letters.tolist()]
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of all texts, and the number of each one's text."""
    joined = " ".join(["", *texts, ""])
    points = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in texts)]) - 1
    owner = np.append(owner, len(texts) - 1)[: len(points)]
    keep = np.append(True, (points[1:] != 32) | (points[:-1] != 32))
    points, owner = points[keep].astype(np.uint64), np.maximum(owner[keep], 0)
    pairs = points[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triples = pairs[:-1] * np.uint64(31) + points[2:] * np.uint64(0x165667B19E3779F9)
    letters = points != 32
    ok = (letters[:-1] | letters[1:]) & (owner[:-1] == owner[1:]) | letters[1:]
    ok3 = letters[1:-1]
    mix = lambda x: (((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
    # An n-gram that begins at the space before a text belongs to that text.
    return np.concatenate([mix(pairs[ok]), mix(triples[ok3])]), np.concatenate([np.where(letters[1:], owner[1:], owner[:-1])[ok], owner[1:-1][ok3]])


def parts(texts: list[str], most: int = PART) -> Iterator[tuple[list[str], np.ndarray]]:
    """Groups of parts of the texts, of about `most` characters, and the number of each one's text. Parts are cut at white space, over which no n-gram reaches (but for those that begin or end with it)."""
    group, owner, size = [], [], 0
    for i, text in enumerate(texts):
        start, end = 0, len(text)
        while start < end or not end:
            stop = end
            if end - start > most and (cut := max(text.rfind(" ", start + 1, start + most), text.rfind("\n", start + 1, start + most))) > 0:
                stop = cut
            if group and size + stop - start > most:
                yield group, np.array(owner)
                group, owner, size = [], [], 0
            group.append(text[start:stop])
            owner.append(i)
            size += stop - start
            start = stop
            if not end:
                break
    if group:
        yield group, np.array(owner)


def counted(texts: list[str]) -> np.ndarray:
    """The count of each n-gram of each text, flat: text << BITS | bucket."""
    out = np.zeros(len(texts) << BITS, np.int64)
    for group, owners in parts(texts):
        buckets, owner = ngrams(group)
        if len(buckets):
            low, high = int(owners[0]), int(owners[-1]) + 1
            out[low << BITS : high << BITS] += np.bincount((owners[owner] - low) << BITS | buckets, minlength=(high - low) << BITS)
    return out


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # n-grams by languages


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows of df with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, most=SLICE):
                langs = np.array(part.column("lang").to_pylist(), object)
                for group, owners in parts(texts_of(part)):
                    buckets, owner = ngrams(group)
                    for lang in {*langs[owners].tolist()}:
                        mine = buckets[(langs[owners] == lang)[owner]] if len(owner) else buckets
                        counts[lang] = counts.get(lang, 0) + np.bincount(mine, minlength=1 << BITS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "ngram": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    rows = df.where(F.col(lang_col).isNotNull()).select(df[lang_col].alias("lang"), df[text_col].alias("text"))
    counts = map_arrow(rows, run, "lang string, ngram int, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    got = counts.limit(MAX_CELLS + 1).toArrow()
    if len(got) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} cells: too many languages for one model")
    names = got.column("lang").to_numpy()
    languages = sorted({*names.tolist()})
    n = np.full((1 << BITS, len(languages)), PRIOR)
    n[got.column("ngram").to_numpy(), np.searchsorted(np.array(languages, object), names) if languages else []] += got.column("n").to_numpy()
    return Model(languages, np.log(n / n.sum(0)).astype(np.float32))


def _mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares after the rounds of expectation-maximisation, and the log-likelihood. p: likelihoods by n-gram and language; n: counts."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(ROUNDS):
        mixed = np.einsum("ij,ij->i", p, share[owner])
        share = share * np.add.reduceat(p * (n / np.maximum(mixed, 1e-30))[:, None], starts) / total
    return share, np.add.reduceat(n * np.log(np.maximum(np.einsum("ij,ij->i", p, share[owner]), 1e-30)), starts)


def _expected(p: np.ndarray) -> tuple[float, float]:
    """Mean and standard deviation of the log-likelihood of an n-gram drawn from p."""
    log_p = np.log(p)
    mean = (p * log_p).sum()
    return mean, np.sqrt(max((p * log_p * log_p).sum() - mean * mean, 0))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Language, score and the shares of the chosen set of each text."""
    return predict_fits(model, texts, False)[:3]


def predict_fits(model: Model, texts: list[str], ask: bool = True) -> tuple[list[str], np.ndarray, list[dict[str, float]], np.ndarray]:
    """As predict, and whether the chosen set explains the text about as well as texts of its own (False where it isn't asked for)."""
    k, size = len(model.languages), len(texts)
    names, scores, shares, fits = [UNKNOWN] * size, np.zeros(size), [{} for _ in texts], np.zeros(size, bool)
    cells = counted(texts) if k else np.zeros(0, np.int64)
    at = np.flatnonzero(cells)
    if not len(at):
        return names, scores, shares, fits
    n, log_p = cells[at].astype(np.float64), model.log_p[at & ((1 << BITS) - 1)].astype(np.float64)
    docs, starts, owner = np.unique(at >> BITS, return_index=True, return_inverse=True)
    top = log_p.max(1)
    p = np.exp(log_p - top[:, None])
    single = np.add.reduceat(n[:, None] * log_p, starts)
    base = np.add.reduceat(n * top, starts)
    grams = np.add.reduceat(n, starts)
    full, most = _mixture(p, n, starts, owner, np.full((len(docs), k), 1 / k))
    # The best single language leads; the others follow by their share.
    lead, rows = single.argmax(1), np.arange(len(docs))
    full[rows, lead] += 2
    order = np.argsort(-full, axis=1, kind="stable")
    best, value = np.zeros((len(docs), k)), single[rows, lead]
    best[rows, lead] = 1
    penalty = PENALTY * grams + LOG_PENALTY * np.log1p(grams)
    open_rows = rows[most + base - penalty > value]  # no set is likelier than the mixture of all
    for m in range(2, k + 1):
        if not len(open_rows):
            break
        allowed = np.zeros((len(docs), k), bool)
        np.put_along_axis(allowed, order[:, :m], True, 1)
        pick = np.isin(owner, open_rows)
        new, place = np.unique(owner[pick], return_inverse=True)
        share, like = _mixture(p[pick], n[pick], np.flatnonzero(np.append(True, place[1:] != place[:-1])), place, (allowed[new] / m))
        like = like + base[new] - (m - 1) * penalty[new]
        better = like > value[new]
        open_rows = new[better]
        best[open_rows], value[open_rows] = share[better], like[better]
    # Confidence: how far the leading language explains the text better than the others do, for each n-gram.
    gap = np.exp(np.clip((single - single.max(1, keepdims=True)) / np.sqrt(grams)[:, None], -50, 0))
    sure = 1 / gap.sum(1)
    choice = best.argmax(1)
    if ask:
        found = (np.add.reduceat(n * np.log(np.maximum(np.einsum("ij,ij->i", p, best[owner]), 1e-30)), starts) + base) / grams
        whole = np.exp(model.log_p.astype(np.float64))
        alone = np.array([_expected(whole[:, j]) for j in range(k)])
        mixed = (best > 0).sum(1) > 1
        mean, spread = np.where(mixed[:, None], 0.0, alone[choice]).T
        for i in np.flatnonzero(mixed).tolist():
            mean[i], spread[i] = _expected(whole @ best[i])
        fits[docs] = found >= mean - SLACK - ERRORS * spread / np.sqrt(grams)
    for i, doc in enumerate(docs.tolist()):
        names[doc], scores[doc] = model.languages[choice[i]], best[i, choice[i]] * sure[i]
        shares[doc] = {model.languages[j]: float(best[i, j]) for j in np.flatnonzero(best[i] > 0)}
    return names, scores, shares, fits


def identify(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "", fits: bool = False) -> DataFrame:
    """df with lang_pred, score and shares (a map of the languages found), and fits if asked for, their names after prefix, in place of columns of these names.

    The model, of bounded size, is broadcast.
    """
    names = [prefix + c for c in ("lang_pred", "score", "shares", *["fits"] * fits)]
    source, columns = fresh(df, "__text"), [c for c in df.columns if c not in names]
    df = df.select(*columns, df[text_col].alias(source))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source, SLICE):
                for i in range(0, part.num_rows, 512):
                    few = part.slice(i, 512)
                    langs, scores, shares, fit = predict_fits(shared.value, texts_of(few, source), fits)
                    found = pa.array([[*s.items()] for s in shares], pa.map_(pa.string(), pa.float64()))
                    yield pa.RecordBatch.from_arrays([*few.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), found, *[pa.array(fit)] * fits], [*columns, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return map_arrow(df, run, f"{fields}{', ' if fields else ''}`{names[0]}` string, `{names[1]}` double, `{names[2]}` map<string, double>{f', `{names[3]}` boolean' if fits else ''}")


def known_only(df: DataFrame, model: Model, text_col: str = "text", least: float = LEAST, lang_col: str | None = None) -> DataFrame:
    """df without the rows of unknown language, of a score below least, or that no set of the languages fits; a null lang_col, if named, becomes the language found."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    rows = identify(df, model, text_col, prefix, True)
    rows = rows.where((F.col(f"{prefix}lang_pred") != UNKNOWN) & (F.col(f"{prefix}score") >= least) & F.col(f"{prefix}fits"))
    return rows.select(*[F.coalesce(c, f"{prefix}lang_pred").alias(c) if c == lang_col else c for c in df.columns])
