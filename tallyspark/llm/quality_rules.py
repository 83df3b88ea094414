"""Quality rules: divergence of a text's histograms from language references.

Two histograms of each text, of character classes and of common words, are compared by Jensen-Shannon distance with
references of each language, which are the mean histograms over all documents of that language that pass the
base rules. Every value of `lang` with `least_documents` such documents makes a reference (one of fewer would be measured against itself);
the nearest reference counts, whatever the document's own `lang`. Only the references, some 130 numbers a language, reach the driver. A text is kept if the base rules hold
and both distances stay below their thresholds; as short samples diverge by chance, a
threshold grows by `slack` / sqrt(characters or words), and texts below `least_words` are not judged by words. Base
rules: at least 50 words, and at most half of them in three-word windows that the text repeats.

Null texts count as empty; they and blank ones have no words and fail the base rules. Whole texts are read, in slices of
bounded size. Without any reference (too few documents pass) the base rules decide alone. Repeated ids are rows of their own; of two
references as near as each other the first by name counts. An empty table gives an empty one; columns beside doc_id, lang and text don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import stored

# Common words by language.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be this by from or an at not have they which you were",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
    "fr": "de la le et les des en un une que est pour qui dans par du sur au il pas ce plus avec ne se son sont",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha",
}
SYMBOLS = b"#*$%&|<>"
CLASS_LIMIT, WORD_LIMIT, SLACK, LEAST_DOCUMENTS = 0.145, 0.5, 0.6, 5
#: lower or digit (numbers alone don't make a text worse), upper, beyond ASCII, full stop and comma, other marks, blank, line end, control, the symbols one by one
CLASSES = 8 + len(SYMBOLS)
_CLASS = np.full(256, 7, np.int64)
_CLASS[33:127] = 4
_CLASS[97:123] = _CLASS[48:58] = 0
_CLASS[65:91] = 1
_CLASS[0xC0:] = 2
_CLASS[[44, 46]] = 3
_CLASS[32] = 5
_CLASS[10] = 6
for _k, _c in enumerate(SYMBOLS):
    _CLASS[_c] = 8 + _k


def common_words() -> list[str]:
    return sorted({w for words in COMMON.values() for w in words.split()})


def measure(texts: K.Texts, common: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Counts and histograms of every text."""
    n, data = len(texts), texts.data
    starts, ends, of = texts.words()
    n_words = np.bincount(of, minlength=n)
    points = texts.code_points()
    word_chars = np.bincount(of, points[ends] - points[starts], n).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(texts.offsets))
    lead = (data & 0xC0) != 0x80
    hist = np.bincount(owner[lead] * CLASSES + _CLASS[data[lead]], minlength=n * CLASSES).reshape(n, CLASSES)
    n_symbols = hist[:, 8:].sum(1)

    # lines with a word that equal an earlier one
    first, last, line_of = K.spans(data != 10, texts.offsets)
    blank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~K._SPACE[data], out=blank[1:])
    worded = blank[last] > blank[first]
    first, last, line_of = first[worded], last[worded], line_of[worded]
    key = texts.hashes(first, last) ^ K.mix(line_of.astype(np.uint64), 5)
    unique, index = np.unique(key, return_index=True)
    n_dup_lines = np.bincount(line_of, minlength=n) - np.bincount(line_of[index], minlength=n)

    # words in three-word windows that come twice or more
    windows, window_of, at = K.shingles(texts.hashes(starts, ends), of, n, 3, whole=False)
    key = windows ^ K.mix(window_of.astype(np.uint64), 9)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    same = key[order[1:]] == key[order[:-1]]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(of), bool)
    for j in range(3):
        covered[at[again] + j] = True
    n_repeat_words = np.bincount(of[covered], minlength=n)

    # common words, with the marks around them taken off at the end
    mark = np.isin(data[np.maximum(ends - 1, 0)], list(b".,;:!?")) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    low = texts.hashes(starts, ends - mark, lower=True)
    hashes, place = common
    where = np.minimum(np.searchsorted(hashes, low), len(hashes) - 1)
    hit = hashes[where] == low
    words = np.bincount(of[hit] * len(hashes) + place[where[hit]], minlength=n * len(hashes)).reshape(n, len(hashes)) if len(of) else np.zeros((n, len(hashes)), np.int64)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "classes": hist, "words": np.column_stack([words, n_words - words.sum(1)])}


def _hashed_common() -> tuple[np.ndarray, np.ndarray]:
    texts = next(K.slices(pa.array(common_words())))
    h = texts.hashes(texts.offsets[:-1], texts.offsets[1:], lower=True)
    order = np.argsort(h)
    return h[order], order


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches):
    common = _hashed_common()
    for batch in batches:
        for texts in K.slices(batch.column(2)):
            m = measure(texts, common)
            part = batch.slice(texts.first, len(texts))
            each = lambda x: K.list_array(x.astype(np.int32).ravel(), np.full(len(x), x.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), each(m["classes"]), each(m["words"])], ["doc_id", "lang", *COUNTS, "classes", "words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2: 0 to 1) of the rows of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum(0, part / 2))


def _summed(names: dict[str, int]):
    """The sums of the histograms' shares, and how many, by language: (lang, place, total, n)."""

    def run(batches):
        sums: dict[str, tuple[np.ndarray, int]] = {}
        for batch in batches:
            parts = [batch.column(k + 1).flatten().to_numpy().reshape(batch.num_rows, n).astype(float) for k, n in enumerate(names.values())]
            shares = np.column_stack([p / np.maximum(1, p.sum(1))[:, None] for p in parts])
            lang = np.array(batch.column(0).to_pylist(), object)
            for x in set(lang.tolist()):
                old, n = sums.get(x, (0.0, 0))
                sums[x] = (old + shares[lang == x].sum(0), n + int((lang == x).sum()))
        for x, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(total), pa.string()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], ["lang", "place", "total", "n"])

    return run


def judge(docs: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, slack: float = SLACK, least_words: int = 100, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, counts, base_failed, kept, class_distance, word_distance, language) of every row of `docs` (doc_id, lang, text)."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    facts = stored(rows.mapInArrow(K.tidy(_measured), f"doc_id {kind}, lang string, {counts}, classes array<int>, words array<int>"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    # references: the mean histogram of each language over all its documents that pass; each task sums up its own first
    names = {"classes": CLASSES, "words": len(common_words()) + 1}
    passing = facts.filter(~failed & F.col("lang").isNotNull()).select("lang", "classes", "words")
    parts = passing.mapInArrow(K.tidy(_summed(names)), "lang string, place int, total double, n long")
    sums = parts.groupBy("lang", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter(F.col("n") >= least_documents)
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], np.zeros(sum(names.values())))[r["place"]] = r["total"] / r["n"]
    languages = sorted(found)
    means = np.array([found[x] for x in languages]).reshape(-1, sum(names.values()))
    reference = {"classes": means[:, :CLASSES], "words": means[:, CLASSES:]}

    def run(batches):
        for batch in batches:
            n_words = batch.column(1).to_numpy()
            n = len(n_words)
            size = {"classes": None, "words": None}
            dist = {}
            for k, c in enumerate(("classes", "words")):
                h = batch.column(2 + k).flatten().to_numpy().reshape(n, names[c]).astype(float)
                size[c] = np.maximum(1, h.sum(1))
                p = h / size[c][:, None]
                dist[c] = np.array([distance(p, q) for q in reference[c]]).reshape(len(languages), n)
            if languages:
                best = (dist["classes"] + dist["words"]).argmin(0)
                a, b = dist["classes"][best, np.arange(n)], dist["words"][best, np.arange(n)]
                name = [languages[k] for k in best]
            else:
                a = b = np.zeros(n)
                name = [None] * n
            good = (a <= class_limit + slack / np.sqrt(size["classes"])) & ((b <= word_limit + slack / np.sqrt(size["words"])) | (n_words < least_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in range(4, 4 + len(COUNTS))), batch.column(9), pa.array(good), pa.array(a), pa.array(b), pa.array(name, pa.string())], ["doc_id", *COUNTS, "base_failed", "good", "class_distance", "word_distance", "language"])

    seen = facts.select("doc_id", F.col("n_words").alias("w"), "classes", "words", *COUNTS, failed.alias("base_failed"))
    out = seen.mapInArrow(K.tidy(run), f"doc_id {kind}, {counts}, base_failed boolean, good boolean, class_distance double, word_distance double, language string")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("good")).alias("kept"), "class_distance", "word_distance", "language")


def oracle() -> str:
    """The same as DuckDB SQL, distances rounded to six places."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    word = r"[^\x20\x09-\x0D]"
    kinds = ["[^a-z0-9]", "[^A-Z]", r"[\x00-\x7F]", "[^.,]", r"""[^!"'()+/:;=?@\[\\\]^_`{}~-]""", "[^ ]", r"[^\n]"]
    counts = [f"length(regexp_replace(t, {q(k)}, '', 'g'))" for k in kinds]
    marks = [f"length(t) - length(replace(t, {q(chr(c))}, ''))" for c in SYMBOLS]
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bare = lower.format("CASE WHEN length(x) > 1 AND right(x, 1) IN ('.', ',', ';', ':', '!', '?') THEN left(x, length(x) - 1) ELSE x END")
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY 1),
f AS (SELECT w.doc_id, lang, t, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(t) AS chars FROM f),
c AS (SELECT doc_id, [{", ".join(counts)}] AS a, [{", ".join(marks)}] AS m, chars FROM b),
hc AS (SELECT doc_id, unnest(range(0, {CLASSES})) AS k, unnest(list_concat(list_append(a, chars - list_sum(a) - list_sum(m)), m)) AS n FROM c),
v AS (SELECT unnest([{", ".join(map(q, common_words()))}]) AS k),
x AS (SELECT doc_id, unnest(w) AS x FROM b), y AS (SELECT doc_id, {bare} AS k FROM x),
hw AS (SELECT doc_id, coalesce(v.k, '') AS k, count(*) AS n FROM y LEFT JOIN v ON v.k = y.k GROUP BY 1, 2),
h AS (SELECT 'c' AS kind, hc.doc_id, k::VARCHAR AS k, n / chars::DOUBLE AS p FROM hc JOIN b ON b.doc_id = hc.doc_id WHERE n > 0 UNION ALL SELECT 'w', hw.doc_id, k, n / n_words::DOUBLE FROM hw JOIN b ON b.doc_id = hw.doc_id),
s AS (SELECT lang, count(*) AS n FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_DOCUMENTS}),
ref AS (SELECT b.lang, kind, k, sum(p) / any_value(s.n)::DOUBLE AS p FROM h JOIN b ON b.doc_id = h.doc_id JOIN s ON s.lang = b.lang WHERE NOT base_failed GROUP BY 1, 2, 3),
part AS (SELECT h.doc_id, h.kind, s.lang, sum(h.p * log2(2 * h.p / (h.p + coalesce(ref.p, 0))) + CASE WHEN ref.p > 0 THEN ref.p * log2(2 * ref.p / (h.p + ref.p)) - ref.p ELSE 0 END) AS z FROM h CROSS JOIN s LEFT JOIN ref ON ref.kind = h.kind AND ref.k = h.k AND ref.lang = s.lang GROUP BY 1, 2, 3),
dist AS (SELECT b.doc_id, s.lang, sqrt(greatest(0, (1 + coalesce(pc.z, 0)) / 2)) AS dc, sqrt(greatest(0, (1 + coalesce(pw.z, 0)) / 2)) AS dw FROM b CROSS JOIN s LEFT JOIN part pc ON pc.doc_id = b.doc_id AND pc.kind = 'c' AND pc.lang = s.lang LEFT JOIN part pw ON pw.doc_id = b.doc_id AND pw.kind = 'w' AND pw.lang = s.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dc + dw, lang) AS i FROM dist)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dc <= {CLASS_LIMIT} + {SLACK} / sqrt(greatest(1, chars)) AND (dw <= {WORD_LIMIT} + {SLACK} / sqrt(greatest(1, n_words)) OR n_words < 100) AS kept, round(dc, 6) AS class_distance, round(dw, 6) AS word_distance, best.lang AS language FROM b JOIN best ON best.doc_id = b.doc_id AND i = 1"""
