"""Problem 8: per-document text quality statistics.

Statistics are computed over whole texts, many texts at once: a task strings the texts of an Arrow batch together as
code points, looks each code point's class up in a table and counts classes, runs and lines by array operations; words
are looked at once per distinct word of the batch.  Thresholds on the statistics are noisy labelling functions, each
voting prose, junk or nothing.  Their accuracies are learned without labels by expectation-maximisation on their
agreements: votes are counted per pattern of votes in Spark (at most 3**12 patterns, whatever the input), the
iterations run on those counts, and the learned log-odds are applied to every document as one expression.  The
posterior is the text type.

Common words go to the tasks as a set where their table is small (``WORD_BYTES``, counted); a larger one is joined with
the distinct words of each text.

Defined results: a NULL text has no statistics and no type (NULL posterior); an empty or blank text counts as prose
with the prior's posterior, as nothing speaks against it; very long texts are read whole; repeated documents get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.joins import Written, written
from plumbline.session import shared_folder

#: Code points strung together at once; one longer text is a batch of its own.
BATCH_CHARS = 1 << 21
#: Bytes of the table of common words that may be sent to every task.
WORD_BYTES = 4 << 20
_BREAK = re.compile(r"<br\s*/?>|</p>|</li>", re.IGNORECASE)
_TAG = re.compile(r"<[a-zA-Z/][^<>]{0,80}>")
#: Marks that make a list item with what follows them: numbers and boxes; other bullets stand alone.
_ITEM = re.compile(r"\d+[.)]\s|\[[ xX]\]", re.ASCII)
#: Latin words nobody can pronounce: five consonants in a row, or three letters and more without a vowel, or a letter three times.
_ROUGH = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|^[bcdfghjklmnpqrstvwxz]{3,}$|(.)\1\1")
PROSE, JUNK, NOTHING = 1, 0, -1

# Classes of code points, one bit each.
_LETTER, _DIGIT, _SPACE, _MARK, _SEPARATOR, _BREAKS, _ENDS, _CLOSES, _BULLET, _BLANK = (1 << i for i in range(10))
_SETS = {
    _SPACE: " \t\n\v\f\r",
    _MARK: ".,;:!?'\"()’“”„«»¿¡-",
    _SEPARATOR: "|>#=/\\_{}[]<;*•~,",
    _BREAKS: "\n\v\f\r\x85\u2028\u2029",
    _ENDS: ".!?…",
    _CLOSES: "\"'”’»)] \t\n\v\f\r",
    _BULLET: "-•*·–▪#>|+=~",
    _BLANK: " ",
}


class _Classes:
    """Class bits of code points, filled in as they are met."""

    def __init__(self) -> None:
        self.bits = np.zeros(0x110000, np.uint16)
        self.known = np.zeros(0x110000, bool)

    def of(self, points: np.ndarray) -> np.ndarray:
        met = np.flatnonzero(np.bincount(points, minlength=1))
        for c in met[~self.known[met]].tolist():
            kind = unicodedata.category(chr(c))
            bit = _LETTER if kind[0] in "LM" else _DIGIT if kind[0] == "N" else 0
            bit |= _CLOSES if kind == "So" else 0
            for b, chars in _SETS.items():
                bit |= b if chr(c) in chars else 0
            self.bits[c], self.known[c] = bit, True
        return self.bits[points]


def _runs(on: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; ``first`` is true where a text begins."""
    edge = on.copy()
    edge[1:] &= ~on[:-1] | first[1:]
    start = np.flatnonzero(edge)
    stop = on.copy()
    stop[:-1] &= ~on[1:] | first[1:]
    return start, np.flatnonzero(stop) + 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def measure(texts: list[str], common: frozenset[str], classes: _Classes) -> dict[str, np.ndarray]:
    """The statistics of texts without NULLs, as arrays."""
    plains = [_TAG.sub(" ", _BREAK.sub("\n", t)) if "<" in t else t for t in texts]
    n = len(plains)
    lens = np.fromiter(map(len, plains), np.int64, n)
    ends = np.cumsum(lens)
    starts = ends - lens
    text = "".join(plains)
    bits = classes.of(_points(text)) if text else np.zeros(0, np.uint16)
    size = len(bits)
    first = np.zeros(size, bool)
    first[starts[lens > 0]] = True

    def per_text(mask: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(mask)]
        return upto[ends] - upto[starts]

    def text_of(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, at, side="right")

    has = lambda b: (bits & b) != 0
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    space = has(_SPACE)
    chars = per_text(~space)
    tokens = np.bincount(text_of(_runs(~space, first)[0], ends), minlength=n)

    # Lines: runs between breaks that hold more than blanks.
    begin, stop = _runs(~has(_BREAKS), first)
    row = np.arange(size)
    filled = np.r_[0, np.cumsum(~has(_BLANK))]
    keep = filled[stop] > filled[begin]
    begin, stop = begin[keep], stop[keep]
    line_of = text_of(begin, ends)
    lines = np.bincount(line_of, minlength=n)
    finished = long = np.zeros(n)
    in_lists = np.zeros(n)
    if len(begin):
        last = np.maximum.accumulate(np.where(~has(_CLOSES), row, -1))[stop - 1]
        done = (last >= begin) & ((bits[np.maximum(last, 0)] & _ENDS) != 0)
        finished = np.bincount(line_of, done, minlength=n)
        inked = ~has(_BLANK)
        end = np.maximum.accumulate(np.where(inked, row, -1))[stop - 1] + 1
        head = np.minimum.accumulate(np.where(inked, row, size)[::-1])[::-1][begin]
        long = np.bincount(line_of, end - head, minlength=n)
        bullet = (bits[head] & _BULLET) != 0
        lead = _points(text)[head]
        for i in np.flatnonzero(~bullet & ((lead == ord("[")) | ((lead >= 48) & (lead <= 57)))).tolist():
            bullet[i] = _ITEM.match(text, head[i], end[i]) is not None
        in_lists = np.bincount(line_of[bullet], (end - head)[bullet], minlength=n)

    # Words: runs of letters of the text in lower case.
    low = text.lower()
    if len(low) != size:
        small = [p.lower() for p in plains]
        low, low_lens = "".join(small), np.fromiter(map(len, small), np.int64, n)
        low_ends = np.cumsum(low_lens)
        low_first = np.zeros(len(low), bool)
        low_first[(low_ends - low_lens)[low_lens > 0]] = True
    else:
        low_ends, low_first = ends, first
    letters = (classes.of(_points(low)) & _LETTER) != 0 if low else np.zeros(0, bool)
    w0, w1 = _runs(letters, low_first)
    word_of = text_of(w0, low_ends)
    words = np.bincount(word_of, minlength=n)
    code, kinds = pd.factorize(np.array([low[a:b] for a, b in zip(w0.tolist(), w1.tolist(), strict=True)], object))
    known = np.fromiter((w in common for w in kinds), bool, len(kinds))
    rough = np.fromiter((_ROUGH.search(w) is not None for w in kinds), bool, len(kinds))
    pairs = np.unique(word_of * max(len(kinds), 1) + code)
    pair_of, pair_code = pairs // max(len(kinds), 1), pairs % max(len(kinds), 1)
    longest = np.zeros(n)
    if len(w0):
        some = np.flatnonzero(words)
        longest[some] = np.maximum.reduceat(w1 - w0, np.searchsorted(word_of, some))
    return {
        "word_count": tokens,
        "mean_word_length": share(chars, tokens),
        "symbol_share": share(per_text((bits & (_LETTER | _DIGIT | _SPACE | _MARK)) == 0), chars),
        "terminal_share": share(finished, lines),
        "common_share": share(np.bincount(word_of, known[code], minlength=n), words) if len(code) else np.zeros(n),
        "line_count": lines,
        "words_per_line": share(tokens, lines),
        "digit_share": share(per_text(has(_DIGIT)), chars),
        "letter_share": share(per_text(has(_LETTER)), chars),
        "bullet_share": share(in_lists, long),
        "common_kinds": np.bincount(pair_of, known[pair_code], minlength=n) if len(code) else np.zeros(n),
        "rough_share": share(np.bincount(word_of, rough[code], minlength=n), words) if len(code) else np.zeros(n),
        "longest_word": longest,
        "distinct_words": np.bincount(pair_of, minlength=n),
        "letter_words": words,
        "separators_per_word": share(per_text(has(_SEPARATOR)), tokens),
    }


WHOLE = ("word_count", "line_count", "common_kinds", "distinct_words", "letter_words")
STATISTICS = (
    "word_count",
    "mean_word_length",
    "symbol_share",
    "terminal_share",
    "common_share",
    "line_count",
    "words_per_line",
    "digit_share",
    "letter_share",
    "bullet_share",
    "common_kinds",
    "rough_share",
    "longest_word",
    "distinct_words",
    "letter_words",
    "separators_per_word",
)


def statistics(documents: DataFrame, common_words: DataFrame, word_bytes: int = WORD_BYTES) -> DataFrame:
    """doc_id, absent and the statistics of ``text``; shares are of the characters, lines or words named.

    ``common_words`` has the column ``word``; words of all languages count alike.
    """
    table = written(common_words.where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct())
    small = table.bytes <= word_bytes
    common = frozenset(r["word"] for r in table.df.collect()) if small else frozenset()
    if small:
        return _measured(documents.select("doc_id", "text"), common)
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    return _with_joined_words(_measured(keyed, common), keyed, table)


def _measured(documents: DataFrame, common: frozenset[str]) -> DataFrame:
    """Columns of ``documents`` but ``text``, absent and the statistics."""
    keep = [f for f in documents.schema if f.name != "text"]
    schema = T.StructType([*keep, T.StructField("absent", T.BooleanType())])
    for c in STATISTICS:
        schema.add(c, T.IntegerType() if c in WHOLE else T.DoubleType())
    target = to_arrow_schema(schema)
    words = documents.sparkSession.sparkContext.broadcast(common)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes()
        for b in batches:
            texts = b.column("text").to_pylist()
            there = np.fromiter((t is not None for t in texts), bool, len(texts))
            parts: list[dict[str, np.ndarray]] = []
            some: list[str] = []
            held = 0
            for t in texts:
                if t is None:
                    continue
                if some and held + len(t) > BATCH_CHARS:
                    parts.append(measure(some, words.value, classes))
                    some, held = [], 0
                some.append(t)
                held += len(t)
            parts.append(measure(some, words.value, classes))
            cols = [*[b.column(f.name) for f in keep], pa.array(~there)]
            for c in STATISTICS:
                kind = np.int32 if c in WHOLE else np.float64
                full = np.zeros(len(texts), kind)
                full[there] = np.concatenate([p[c] for p in parts]).astype(kind)
                cols.append(pa.array(full))
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return documents.mapInArrow(stream, schema)


def _with_joined_words(stats: DataFrame, documents: DataFrame, table: Written) -> DataFrame:
    """``stats`` with the common-word figures from a join of the distinct words of each text with a large table."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?i)<br\s*/?>|</p>|</li>", "\n"), r"<[a-zA-Z/][^<>]{0,80}>", " ")
    key = F.struct("doc_id", "_hash").alias("_key")
    words = documents.where("text IS NOT NULL").select(key, F.filter(F.split(F.lower(plain), r"[^\p{L}\p{M}]+"), lambda w: w != "").alias("w")).dropDuplicates(["_key"])
    words = words.select("_key", F.explode("w").alias("word")).groupBy("_key", "word").agg(F.count("*").alias("times"))
    found = words.join(table.df, "word").groupBy("_key").agg(F.sum("times").alias("_times"), F.count("*").alias("_kinds"))
    out = stats.drop("common_share", "common_kinds").withColumn("_key", key).join(found, "_key", "left")
    share = F.coalesce(F.try_divide(F.col("_times"), F.col("letter_words")), F.lit(0.0)).cast("double")
    made = {"common_share": share, "common_kinds": F.coalesce("_kinds", F.lit(0)).cast("int")}
    return out.select("doc_id", "absent", *[made[c].alias(c) if c in made else c for c in STATISTICS])


#: Labelling functions: name -> (votes prose where, votes junk where); conditions over the statistics.
FUNCTIONS: dict[str, tuple[str, str]] = {
    "common": ("letter_words >= 3 AND common_share >= 0.2", "letter_words >= 6 AND common_share < 0.1"),
    "kinds": ("common_kinds >= 5", "letter_words >= 15 AND common_kinds <= 2 AND common_kinds <= 0.15 * distinct_words"),
    "rough": ("letter_words >= 4 AND rough_share <= 0.08", "letter_words >= 5 AND rough_share > 0.2"),
    "letters": ("letter_share >= 0.85", "word_count > 0 AND letter_share < 0.65"),
    "symbols": ("symbol_share <= 0.02", "symbol_share > 0.08"),
    "digits": ("digit_share <= 0.05", "digit_share > 0.15"),
    "lines": ("words_per_line >= 5", "line_count >= 4 AND words_per_line < 4"),
    "bullets": ("bullet_share <= 0.3", "line_count >= 3 AND bullet_share >= 0.7"),
    "lengths": ("mean_word_length BETWEEN 2.5 AND 8.5", "mean_word_length > 11 OR (word_count >= 5 AND mean_word_length < 2)"),
    "variety": ("letter_words >= 8 AND distinct_words >= 0.5 * letter_words OR distinct_words >= 20", "letter_words >= 10 AND distinct_words <= 0.25 * letter_words AND distinct_words < 10"),
    "endings": ("letter_words >= 3 AND terminal_share >= 0.5", "line_count >= 4 AND terminal_share <= 0.1"),
    "separators": ("separators_per_word <= 0.12", "word_count >= 4 AND separators_per_word > 0.3"),
}


def votes(stats: DataFrame) -> DataFrame:
    """``stats`` with one column v_<name> per labelling function."""
    made = {f"v_{n}": F.when(F.expr(junk), F.lit(JUNK)).when(F.expr(prose), F.lit(PROSE)).otherwise(F.lit(NOTHING)) for n, (prose, junk) in FUNCTIONS.items()}
    return stats.withColumns(made)


def learn(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.1, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of junk, table[function, class, vote]) by expectation-maximisation on counted vote patterns.

    A function that abstains says nothing.  Accuracies start from the votes' meaning and are smoothed, so a function
    that is hardly ever used keeps a mild trust.
    """
    m = patterns.shape[1]
    # p[j, class, vote]: chance that function j, when it votes, votes so; classes 0 junk, 1 prose.
    p = np.empty((m, 2, 2))
    p[:, 0] = (0.7, 0.3)
    p[:, 1] = (0.1, 0.9)
    weight = counts.astype(float)
    said = patterns >= 0
    vote = np.where(said, patterns, 0)
    for _ in range(rounds):
        log = np.log(p)
        score = np.stack([np.where(said, log[np.arange(m), c, vote], 0.0).sum(axis=1) for c in (0, 1)], axis=1)
        score += np.log([prior, 1 - prior])
        score -= score.max(axis=1, keepdims=True)
        q = np.exp(score)
        q /= q.sum(axis=1, keepdims=True)
        w = q * weight[:, None]
        new_prior = float(np.clip(w[:, 0].sum() / max(weight.sum(), 1e-9), 1e-3, 0.5))
        new = np.empty_like(p)
        for c in (0, 1):
            for v in (0, 1):
                start = (0.7, 0.3)[v] if c == 0 else (0.1, 0.9)[v]
                new[:, c, v] = (w[:, c : c + 1] * (said & (patterns == v))).sum(axis=0) + 5 * start
        new /= new.sum(axis=2, keepdims=True)
        moved = max(abs(new_prior - prior), float(np.abs(new - p).max()))
        p, prior = new, new_prior
        if moved < 1e-9:
            break
    return prior, p


def posterior(voted: DataFrame) -> tuple[Column, DataFrame]:
    """(chance of junk as a column of ``voted``, the learned accuracies as a table)."""
    names = list(FUNCTIONS)
    cols = [f"v_{n}" for n in names]
    rows = voted.where("NOT absent").groupBy(*cols).count().collect()  # at most 3**len(FUNCTIONS) rows
    patterns = np.array([[r[c] for c in cols] for r in rows], int).reshape(len(rows), len(cols))
    prior, p = learn(patterns, np.array([r["count"] for r in rows], float))
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, c in enumerate(cols):
        weight = np.log(p[j, 0] / p[j, 1])
        odds = odds + F.when(F.col(c) == JUNK, float(weight[0])).when(F.col(c) == PROSE, float(weight[1])).otherwise(0.0)
    chance = F.when(~F.col("absent"), F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    learned = [(n, float(p[j, 0, 0]), float(p[j, 1, 1]), prior) for j, n in enumerate(names)]
    table = voted.sparkSession.createDataFrame(learned, "function string, junk_accuracy double, prose_accuracy double, junk_prior double")
    return chance, table


def text_types(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, the statistics, the votes, ``junk`` (posterior) and ``text_type`` (prose or junk)."""
    # Written once: texts are read a single time, and no filter on the posterior is pushed down into the statistics.
    shared_folder(documents.sparkSession)
    voted = votes(statistics(documents, common_words)).checkpoint()
    chance, _ = posterior(voted)
    return voted.withColumn("junk", chance).withColumn("text_type", F.when(F.col("junk") > 0.5, F.lit("junk")).when(F.col("junk").isNotNull(), F.lit("prose")))
