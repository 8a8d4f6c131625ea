"""Languages of documents and of the stretches in them: string-kernel classification.

Texts are compared by a blended-spectrum presence kernel: for n = 1, 2, 3 the share of character n-grams two texts have
in common (n-grams over folded letters, those of the landmarks only), summed with fixed weights. Landmarks taken from the
labelled sample give a Nyström map, on which one-versus-rest kernel ridge regression is fitted. As the kernel is linear
in the presence of n-grams, all landmarks fold into one matrix (n-grams x languages): a batch of sentences is scored by
one sparse product with it. Sentences in which few n-grams are known (machine data, other languages) stay without a
language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "fr", "de", "es", "zh", "pt", "it", "nl")
#: most labelled rows that are read for the fit
MAX_SAMPLES = 4_000
ORDERS = (1, 2, 3)
WEIGHTS = (0.3, 0.7, 1.0)
HASH_BITS = 20
#: units whose presence matrix is held at once
UNITS_AT_ONCE = 1024
RIDGE = 0.05
#: a sentence counts as one in a language from so many letters (Han characters count thrice) and n-grams known
MIN_LETTERS = 24
MIN_KNOWN = 0.5
MIN_KNOWN_HAN = 0.15
MIN_MARGIN = 0.25
#: longer stretches without a sentence end are scored in parts
MAX_UNIT = 320
RUN_CHARS = 120_000

# fixed values: ISO 639 codes and names by language
NAMES = {
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "castellano"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "汉语", "cmn"),
    "pt": ("pt", "por", "portuguese", "português"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
}


def label_language(label: Column) -> Column:
    """The language a label names, in any spelling (case, blanks, region or script, names, three letters), else null."""
    known = F.create_map(*[F.lit(x) for x in chain(*((n, k) for k, names in NAMES.items() for n in names))])
    bare = F.lower(F.regexp_replace(label, r"[\s 　]+", ""))
    return F.try_element_at(known, F.regexp_extract(bare, r"^([^-_]*)", 1))


_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Lower-case letter of every code point (width and compatibility forms undone); 32 for all that is no letter."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in chain(range(0x250), range(0x370, 0x600), range(0x1E00, 0x2000), range(0xFF21, 0xFF5B)):
            s = unicodedata.normalize("NFKC", chr(c)).lower()
            if len(s) == 1 and s.isalpha():
                table[c] = ord(s)
        for lo, hi in ((0x600, 0x1100), (0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000)):
            table[lo:hi] = np.arange(lo, hi)
        _fold = table
    return _fold


def is_han(folded: np.ndarray) -> np.ndarray:
    """Which folded characters are Han."""
    return (folded >= 0x3400) & (folded < 0xA000)


def unit_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a unit begins: texts, lines, sentences, and parts of very long ones."""
    n = len(cp)
    space = (cp == 32) | (cp == 10) | (cp == 13) | (cp == 9) | (cp == 0xA0) | (cp == 0x3000)
    following = np.append(space[1:], True)
    marks = ((cp == 46) | (cp == 33) | (cp == 63)) & following
    wide = (cp == 0x3002) | (cp == 0xFF01) | (cp == 0xFF1F) | (cp == 0xFF1B)
    cuts = np.zeros(n + 1, dtype=bool)
    cuts[1:] = marks | wide | (cp == 10)
    cuts[offsets] = True
    at = np.flatnonzero(cuts[:n])
    long = np.flatnonzero(np.diff(np.append(at, n)) > MAX_UNIT)
    for u in long:
        lo, hi = at[u], (at[u + 1] if u + 1 < len(at) else n)
        parts = -(-(hi - lo) // MAX_UNIT)
        blanks = lo + np.flatnonzero(space[lo:hi]) + 1
        if len(blanks):
            for k in range(1, parts):
                p = blanks[min(len(blanks) - 1, np.searchsorted(blanks, lo + k * (hi - lo) // parts))]
                if lo < p < hi:
                    cuts[p] = True
    return np.flatnonzero(cuts[:n])


def gram_slots(folded: np.ndarray, order: int) -> np.ndarray:
    """Hash slot of the n-gram at every position (as many as positions; those near the end are meaningless)."""
    h = folded.astype(np.uint64) + np.uint64(order)
    for k in range(1, order):
        h[:-k] = h[:-k] * np.uint64(1_000_003) + folded[k:]
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


@dataclass
class Model:
    """The fitted classifier: slot of every known n-gram by order, and the folded weights by slot and language."""

    slots: list[np.ndarray]
    weights: np.ndarray
    order_of: np.ndarray
    languages: tuple[str, ...]

    def score(self, cp: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """start, text, lang, margin, letters, known of every unit of the texts laid end to end in ``cp``."""
        n = len(cp)
        starts = unit_starts(cp, offsets)
        units = len(starts)
        unit = np.zeros(n, dtype=np.int64)
        unit[starts] = 1
        unit = np.cumsum(unit) - 1
        folded = fold_table()[cp]
        letter = folded != 32
        hits: list[tuple[np.ndarray, np.ndarray]] = []  # (unit, n-gram) by order, in order of the units
        total3 = known3 = np.zeros(units, dtype=np.int64)
        for order, table in zip(ORDERS, self.slots, strict=True):
            if n < order:
                hits.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
                continue
            ids = table[gram_slots(folded, order)][: n - order + 1]
            same = unit[: n - order + 1] == unit[order - 1 :]
            has = letter[: n - order + 1].copy()
            for k in range(1, order):
                has |= letter[k : n - order + 1 + k]
            valid = same & has
            hit = np.flatnonzero(valid & (ids >= 0))
            hits.append((unit[hit], ids[hit].astype(np.int64)))
            if order == 3:
                total3 = np.bincount(unit[: n - 2][valid], minlength=units)
                known3 = np.bincount(unit[hit], minlength=units)
        scores = np.zeros((units, len(self.languages)))
        bases = np.concatenate(([0], np.cumsum([(self.order_of == order).sum() for order in ORDERS])))
        # presence (units x n-grams) times weights, in blocks of units, so that memory does not follow the number of units
        for low in range(0, units, UNITS_AT_ONCE):
            high = min(units, low + UNITS_AT_ONCE)
            for i, (u, g) in enumerate(hits):
                part = slice(*np.searchsorted(u, (low, high)))
                base, width = int(bases[i]), int(bases[i + 1] - bases[i])
                seen = np.zeros((high - low) * width, dtype=bool)
                seen[(u[part] - low) * width + (g[part] - base)] = True
                at = np.flatnonzero(seen)
                if not len(at):
                    continue
                uo, go = at // width, at % width + base
                count = np.bincount(uo, minlength=high - low)
                first = np.flatnonzero(np.concatenate(([True], uo[1:] != uo[:-1])))
                rows = uo[first]
                scores[low + rows] += WEIGHTS[i] * np.add.reduceat(self.weights[go], first, axis=0) / np.sqrt(count[rows])[:, None]
        best = scores.argmax(axis=1)
        top = scores[np.arange(units), best] if units else np.zeros(0)
        rest = scores.copy()
        if units:
            rest[np.arange(units), best] = -np.inf
        margin = top - (rest.max(axis=1) if units else 0)
        han = is_han(folded)
        letters = np.bincount(unit[letter], minlength=units) + 2 * np.bincount(unit[han], minlength=units)
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.where(total3 > 0, known3 / np.maximum(total3, 1), 0.0)
        return {
            "start": starts,
            "text": np.searchsorted(offsets, starts, side="right") - 1,
            "best": best,
            "top": top,
            "margin": margin,
            "letters": letters,
            "han": np.bincount(unit[han], minlength=units),
            "known": known,
        }


def _presence(texts: list[str], slots: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[dict[int, int]]]:
    """0/1 matrices (texts x n-grams) by order; the vocabulary is that of the texts if none is given."""
    out, vocabularies = [], []
    for i, order in enumerate(ORDERS):
        rows = []
        for t in texts:
            folded = fold_table()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            m = max(0, len(folded) - order + 1)
            has = np.zeros(m, dtype=bool)
            for k in range(order):
                has |= folded[k : m + k] != 32
            rows.append(set(gram_slots(folded, order)[:m][has].tolist()))
        if slots is None:
            vocabulary = {s: j for j, s in enumerate(sorted(set().union(*rows)))}
        else:
            vocabulary = {int(s): int(slots[i][s]) for s in np.flatnonzero(slots[i] >= 0)}
        x = np.zeros((len(texts), len(vocabulary)), dtype=np.float64)
        for r, row in enumerate(rows):
            x[r, [vocabulary[s] for s in row if s in vocabulary]] = 1.0
        out.append(x)
        vocabularies.append(vocabulary)
    return out, vocabularies


def fit(samples: list[tuple[str, str]], landmarks_per_language: int = 24) -> Model:
    """Fits (lang, text) pairs. Rows of other languages, nulls and texts without letters are left out."""
    rows = sorted({(lang, t) for lang, t in samples if lang in LANGUAGES and t and t.strip()})
    if not rows:
        raise ValueError("no labelled rows")
    chosen: list[str] = []
    for lang in LANGUAGES:
        own = [t for a, t in rows if a == lang]
        step = max(1, len(own) // landmarks_per_language)
        chosen += own[::step][:landmarks_per_language]
    z, vocabularies = _presence(chosen, None)
    slots = []
    for vocabulary in vocabularies:
        table = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        table[list(vocabulary)] = list(vocabulary.values())
        slots.append(table)
    x, _ = _presence([t for _, t in rows], slots)
    norm = lambda m: m / np.sqrt(np.maximum(m.sum(axis=1), 1))[:, None]
    zn, xn = [norm(m) for m in z], [norm(m) for m in x]
    k_mm = sum(w * m @ m.T for w, m in zip(WEIGHTS, zn, strict=True))
    k_nm = sum(w * a @ b.T for w, a, b in zip(WEIGHTS, xn, zn, strict=True))
    value, vector = np.linalg.eigh(k_mm)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    phi = k_nm @ root
    target = np.array([[1.0 if a == lang else -1.0 / (len(LANGUAGES) - 1) for lang in LANGUAGES] for a, _ in rows])
    beta = np.linalg.solve(phi.T @ phi + RIDGE * len(rows) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    alpha = root @ beta
    weights, order_of, base = [], [], 0
    for order, m, table in zip(ORDERS, zn, slots, strict=True):
        weights.append(m.T @ alpha)
        order_of += [order] * m.shape[1]
        table[table >= 0] += base
        base += m.shape[1]
    return Model(slots, np.concatenate(weights).astype(np.float32), np.array(order_of, dtype=np.int8), LANGUAGES)


def fit_samples(samples: DataFrame) -> Model:
    """The model of a labelled table (lang, text), read up to ``MAX_SAMPLES`` rows (in order of text hash beyond that)."""
    rows = samples.select(label_language(F.col("lang")).alias("lang"), "text").where("lang is not null and text is not null")
    return fit([(r.lang, r.text) for r in rows.orderBy(F.xxhash64("text"), "text").limit(MAX_SAMPLES).collect()])


#: characters without a blank that no word has
LONG_RUN = 40


def _machine(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units that are key-value lines, or consist for the greater part of unbroken runs of ``LONG_RUN`` or more characters
    that are not Han."""
    def per(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[ends] - sums[starts]

    colons, semis, under = per(cp == 58), per(cp == 59), per(cp == 95)
    wide = cp >= 0x2E80
    stop = (cp <= 32) | (cp == 0xA0) | wide
    edges = np.unique(np.concatenate((np.flatnonzero(stop), starts, [len(cp)])))
    runs = np.diff(edges)
    long_chars = np.zeros(len(starts), dtype=np.int64)
    big = np.flatnonzero(runs >= LONG_RUN)
    np.add.at(long_chars, np.searchsorted(starts, edges[big], side="right") - 1, runs[big])
    return ((colons >= 2) & (semis >= 1)) | ((under >= 1) & (colons >= 1)) | (2 * long_chars > ends - starts)


STRETCH = "item_kind string, item_id string, char_start int, char_end int, lang string, confidence double, letters int, whole boolean"


def stretches(texts: DataFrame, model: Model) -> DataFrame:
    """(item_kind, item_id, char_start, char_end, lang, confidence, letters, whole) of every stretch of one language.

    Takes (item_kind, item_id, text). Neighbouring units of one language are joined. ``whole`` says that the stretch
    holds at least one whole sentence long and clear enough to count. Units without a language (machine data, bare
    numbers, too few known n-grams) join the stretch around them. Null and empty texts give no rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("item_kind", pa.string()), ("item_id", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32()), ("whole", pa.bool_())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages)
        for b in batches:
            kinds, ids, bodies = (b.column(i).to_pylist() for i in range(3))
            for first, part in _runs(bodies):
                cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in part])))
                if not len(cp):
                    continue
                s = model.score(cp, offsets[:-1][np.diff(offsets) > 0])
                text_of = np.searchsorted(offsets, s["start"], side="right") - 1
                ends = np.append(s["start"][1:], len(cp))
                plain = ~_machine(cp, s["start"], ends)
                needed = np.where(2 * s["han"] * 3 > s["letters"], MIN_KNOWN_HAN, MIN_KNOWN)
                clear = plain & (s["known"] >= needed) & (s["letters"] >= 6) & (s["margin"] > 0.05)
                whole = clear & (s["letters"] >= MIN_LETTERS) & (s["margin"] >= MIN_MARGIN)
                confidence = np.clip(0.5 + 0.5 * s["margin"], 0.0, 1.0)
                at = np.flatnonzero(clear)
                if not len(at):
                    continue
                # a unit that is not long enough to count never opens a stretch between two of another language
                t, lang, solid = text_of[at], s["best"][at], whole[at]
                keep = solid.copy()
                has_solid = np.zeros(len(part), dtype=bool)
                has_solid[t[solid]] = True
                keep |= ~has_solid[t]
                at, t, lang, solid = at[keep], t[keep], lang[keep], solid[keep]
                new = np.concatenate(([True], (t[1:] != t[:-1]) | (lang[1:] != lang[:-1])))
                head = np.flatnonzero(new)
                letters = np.add.reduceat(s["letters"][at], head)
                weighted = np.add.reduceat(confidence[at] * s["letters"][at], head)
                any_whole = np.logical_or.reduceat(solid, head)
                start = s["start"][at[head]] - offsets[t[head]]
                last_of_text = np.append(t[head][1:] != t[head][:-1], True)
                first_of_text = np.concatenate(([True], t[head][1:] != t[head][:-1]))
                start = np.where(first_of_text, 0, start)
                lengths = np.diff(offsets)[t[head]]
                end = np.where(last_of_text, lengths, np.append(start[1:], 0))
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_kind": [kinds[first + i] for i in t[head].tolist()],
                        "item_id": [ids[first + i] for i in t[head].tolist()],
                        "char_start": start.astype(np.int32),
                        "char_end": end.astype(np.int32),
                        "lang": names[lang[head]].tolist(),
                        "confidence": weighted / letters,
                        "letters": letters.astype(np.int32),
                        "whole": any_whole,
                    },
                    schema=schema,
                )

    wanted = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).select("item_kind", "item_id", "text")
    return wanted.mapInArrow(scan, STRETCH)


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN_CHARS or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def item_languages(found: DataFrame) -> DataFrame:
    """(item_kind, item_id, langs, main, confidence): the languages of every item that has any.

    Stretches of all rows of an item are taken together. A language is present if it has a whole sentence; the main one
    has most letters (ties by name). An item without a whole sentence has just its main language.
    """
    by_lang = found.groupBy("item_kind", "item_id", "lang").agg(
        F.sum("letters").alias("letters"),
        F.sum(F.col("confidence") * F.col("letters")).alias("weighted"),
        F.bool_or("whole").alias("whole"),
    )
    entry = F.struct(-F.col("letters"), "lang", (F.col("weighted") / F.col("letters")).alias("confidence"))
    return by_lang.groupBy("item_kind", "item_id").agg(
        F.collect_set(F.when(F.col("whole"), F.col("lang"))).alias("present"),
        F.min(entry).alias("top"),
    ).select(
        "item_kind",
        "item_id",
        F.array_sort(F.array_union("present", F.array("top.lang"))).alias("langs"),
        F.col("top.lang").alias("main"),
        F.col("top.confidence").alias("confidence"),
    )


def wrong_labels(languages: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_kind, item_id, lang): items whose label is missing, wrong or names no language, or that mix languages.

    ``labels`` is (item_kind, item_id, label), any number of rows an item: one wrong label is enough. One row for each
    language present.
    """
    named = labels.select("item_kind", "item_id", label_language(F.col("label")).alias("named"))
    told = named.groupBy("item_kind", "item_id").agg(
        F.min(F.coalesce("named", F.lit("?"))).alias("least"), F.max(F.coalesce("named", F.lit("?"))).alias("most")
    )
    wrong = (F.size("langs") > 1) | (F.col("least") != F.col("main")) | (F.col("most") != F.col("main"))
    return (
        languages.join(told, ["item_kind", "item_id"])
        .where(wrong)
        .select("item_kind", "item_id", F.explode("langs").alias("lang"))
    )
