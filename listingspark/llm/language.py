"""Language by compression: a text belongs to the language whose dictionary makes it smallest.

Each language has a raw-content zstandard dictionary of texts in that language.  A whole text (letters in
lower case, everything else one space) is encoded in pieces of up to 4,000 bytes once per dictionary, and the
smallest sum names the language.  When the two smallest are within ``close`` bytes, each word is encoded on its own too and
those bytes are added; a text that still has no smallest is rejected as undecided.

A text of 60 letters or more is also rejected when the margin is narrow for its size or when its dictionary hardly helps:
text of a language never learnt, or of no language, is as large with any dictionary as without.  Both limits are taken from
learnt texts that the dictionaries don't hold: half the least margin of all but one in a hundred, and the middle between what the dictionary
leaves of all but one in a hundred and of a text that it doesn't help.

Dictionaries are fitted on at most ``sample_docs`` labelled texts per language of ``sample_chars`` letters
and up to ``dictionary_bytes`` each: a bounded sample by a hash of the id, whatever the size of the table.
A language that has no text of such a length is fitted on texts of any length, long ones cut for the dictionary.
More than ``most_languages`` labels are an error, for each one has its sample on the driver.

Null text, and text without a letter, is ``und`` with score 0 and is rejected; so is everything when no
language was learnt.  Repeated rows are judged alike; of languages with equal sizes the one with more labelled rows wins; an empty
table gives no rows.  Extra columns may have any names.  A very long text takes one pass over its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import ship, slices

_OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
PIECE = 4000  # bytes encoded at a time
ENOUGH = 60  # letters and spaces from which on a text must be like what was learnt


def plain(text: str) -> bytes:
    """Letters in lower case, all else one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


class Languages(dict):
    """Language to dictionary, with the limits beyond which a text is rejected."""

    narrow, helps = 0.0, float("inf")


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = 200, sample_chars: tuple[int, int] = (200, 4000), dictionary_bytes: int = 96 << 10, most_languages: int = 500) -> Languages:
    """Dictionaries learnt from rows with a language for which ``learn`` holds.

    Languages come in order of their number of labelled rows, all counted: the more frequent one wins a tie.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"),
                       F.xxhash64(docs[id_col].cast("string")).alias("place"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.filter("learn AND lang IS NOT NULL AND text IS NOT NULL")
    sized = F.length("text").between(*sample_chars)
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(sized).alias("sized")).limit(most_languages + 1).collect()
    if len(counted) > most_languages:
        raise ValueError(f"more than {most_languages} languages; see most_languages")
    found: dict[str, list[tuple[int, str]]] = {}
    for lang, ranked in _sample(rows.filter(sized), {r.lang: r.sized for r in counted}, sample_docs).items():
        if any(plain(t) for _, t in ranked):
            found[lang] = ranked
    # A language without such texts is learnt from those of any length, of long ones from so many characters on from the first letter.
    missing = {r.lang: r.n for r in counted if r.lang not in found}
    if missing:
        others = rows.filter(F.col("lang").isin(sorted(missing)) & F.col("text").rlike(r"\p{L}")).withColumn(
            "text", F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(sample_chars[1])))
        found.update(_sample(others, missing, sample_docs))
    out, held = Languages(), {}
    for r in sorted(counted, key=lambda r: (-r.n, r.lang)):
        texts = list(dict.fromkeys(t for _, t in sorted(found.get(r.lang, []))))
        learnt = len(texts) - len(texts) // 4
        data = b""
        for used, text in enumerate(texts[:learnt], 1):
            data += plain(text) + b"\n"
            if len(data) >= dictionary_bytes:
                learnt = used
                break
        if data.strip():
            out[r.lang] = data[-dictionary_bytes:]
            held[r.lang] = texts[learnt:]
    _limits(out, held)
    return out


def _sample(rows: DataFrame, counts: dict[str, int], size: int) -> dict[str, list[tuple[int, str]]]:
    """Up to ``size`` rows per language, those with the least places.

    A place is a hash, so four times as many rows as wanted lie below a bound known from the counts; only these travel.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return {}
    bounds = {k: min(1.0, 4 * size / n) for k, n in counts.items()}
    low = F.create_map(*[F.lit(x) for k, b in bounds.items() for x in (k, int(-(1 << 63) + b * ((1 << 64) - 1025)))])
    near = rows.filter(F.col("place") <= F.element_at(low, F.col("lang")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).filter(F.col("rank") <= size)
    out: dict[str, list[tuple[int, str]]] = {}
    for r in ranked.select("lang", "rank", "text").collect():
        out.setdefault(r.lang, []).append((r.rank, r.text))
    return out


def _limits(languages: Languages, held: dict[str, list[str]], least: int = 20) -> None:
    """Set the limits from texts of each language that its dictionary doesn't hold."""
    judge = Classifier(languages)
    margins, rests = [], []
    for lang, texts in held.items():
        for text in texts:
            data = plain(text)
            if len(data) >= ENOUGH and len(languages) > 1:
                costs, alone = judge.costs(data), judge.alone(data)
                own = costs[judge.langs.index(lang)]
                other = min(c for k, c in zip(judge.langs, costs, strict=True) if k != lang)
                if own < other:
                    margins.append((other - own) / own)
                    rests.append(own / alone)
    if len(margins) >= least:
        margins.sort()
        rests.sort()
        languages.narrow = margins[len(margins) // 100] / 2
        languages.helps = (1 + min(1.0, rests[-1 - len(rests) // 100])) / 2


class Classifier:
    """Dictionaries ready for use in a worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 7, close: int = 1):
        import zstandard as z

        plain_of = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.langs = list(dictionaries)
        self.close = close
        self.narrow, self.helps = getattr(dictionaries, "narrow", Languages.narrow), getattr(dictionaries, "helps", Languages.helps)
        self.of = [z.ZstdCompressor(**plain_of, dict_data=z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)) for k in self.langs]
        self.without = z.ZstdCompressor(**plain_of)

    @staticmethod
    def pieces(data: bytes) -> list[bytes]:
        """Pieces of up to ``PIECE`` bytes, cut at spaces where there are any."""
        out, at = [], 0
        while len(data) - at > PIECE:
            cut = data.rfind(b" ", at, at + PIECE) + 1
            out.append(data[at:cut] if cut > at else data[at:at + PIECE])
            at += len(out[-1])
        return [*out, data[at:]] if at < len(data) else out

    def costs(self, data: bytes) -> list[int]:
        parts = self.pieces(data)
        return [sum(len(c.compress(p)) for p in parts) for c in self.of]

    def alone(self, data: bytes) -> int:
        return sum(len(self.without.compress(p)) for p in self.pieces(data))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        data = plain(text) if text else b""
        if not data or not self.langs:
            return UNKNOWN, 0.0, True
        cost = self.costs(data)
        if len(cost) == 1:
            return self.langs[0], 1.0, False
        best, second = sorted(cost)[:2]
        unlike = len(data) >= ENOUGH and (second - best < self.narrow * best or best > self.helps * self.alone(data))
        if second - best <= self.close:
            words: dict[bytes, int] = {}
            for w in data.split():
                words[w] = words.get(w, 0) + 1
            cost = [k + sum(n * len(c.compress(w + b" ")) for w, n in words.items()) for k, c in zip(cost, self.of, strict=True)]
            best, second = sorted(cost)[:2]
        score = 1 / sum(exp(min(best - k, 0) / 2) for k in cost)
        return self.langs[cost.index(best)], score, unlike or second == best


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = 7,
             names: tuple[str, str, str] = ("lang_pred", "score", "rejected"), carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with the predicted language, its score, and whether it is rejected:
    unknown, undecided, or like no language that was learnt.  A carried column with one of the new ``names`` gives way to it."""
    ship(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    inner = docs.select(docs[text_col].cast("string").alias("_judged"), *[docs[c] for c in carry])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in inner.schema.fields[1:]], T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries, level)
        for part in (p for batch in batches for p in slices(batch, 1 << 20, 0)):
            found = [classifier.judge(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], names=[*carry, *names])

    return inner.mapInArrow(run, schema)
