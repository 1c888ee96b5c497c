"""Language identification by cross-parsing: texts are parsed into the longest phrases that a language's sample holds.

Each language has a suffix automaton of labelled text, which knows every string
of the sample. A text is read from left to right, a phrase at a time, each as
long as the automaton can follow it; a character that the sample lacks is a
phrase. The number of phrases, times the bits that tell a place in the sample,
by the length of the text, is the cross entropy of the text under the language
(Ziv and Merhav). The least wins; of equals the name that sorts first.

Whole texts are read, in lower case, with every run of what is no letter or mark
as one space. The sample of a language is bounded: `SAMPLE` labelled rows, those
with the smallest hash of their id, and of each of them a stretch of at most
`PASSAGE` characters that starts at a place that the hash picks. Languages are
taken `TOGETHER` at a time, so a worker's automata are bounded too.

A null text, or one without a letter, is `und` with a score of 0, as is every
text if no language was learned. Rows without an id are not learned from and
their `held_out` is null. Equal ids and repeated rows get a row each; other
columns play no part. The score is from 0 to 1: 1/2 where a second language does
as well as the first, more the worse it does, and 1 if there is no second one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of

SAMPLE = 160
PASSAGE = 400
TOGETHER = 8
UNKNOWN = "und"

_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Between passages; no text has it once it is plain.
_BREAK = "\n"


def plain(text: str | None) -> str:
    """Letters and marks in lower case, with single spaces between; empty if there is no letter."""
    if not text or not _LETTER.search(text):
        return ""
    return _GAP.sub(" ", text.lower()).strip()


def suffix_automaton(text: str) -> dict:
    """The start of the automaton of all strings in the text; a state is the dictionary of its moves."""
    moves: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    for state in moves:
        for c, to in state.items():
            state[c] = moves[to]
    return moves[0]


def phrases(text: str, start: dict) -> int:
    """How many longest phrases of the automaton the text is."""
    nowhere: dict = {}
    count, first, state = 0, start.get, nowhere
    for c in text:
        state = state.get(c)
        if state is None:
            count += 1
            state = first(c, nowhere)
    return count


@lru_cache(maxsize=1)
def automata(samples: tuple[tuple[str, str], ...]) -> list[tuple[str, float, dict]]:
    """Of each (language, sample): the language, the bits of a place in the sample, the automaton.
    A worker holds those of one block of languages from task to task."""
    return [(name, math.log2(max(2, len(text))), suffix_automaton(text)) for name, text in samples]


def best_two(text: str, known: list[tuple[str, float, dict]], held: list[tuple[float, str]] = ()) -> list[tuple[float, str]]:
    """(entropy, language) of the two best, `held` among them."""
    return sorted([*held, *((phrases(text, start) * bits / len(text), name) for name, bits, start in known)])[:2]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, passage: int = PASSAGE) -> dict[str, str]:
    """The sample of each language. Rows are ranked inside their partitions first,
    and only the first `sample` of a language leave one."""
    usable = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)) & F.col(text).rlike(r"\p{L}"))
    spare = F.greatest(F.char_length(text) - F.lit(passage), F.lit(0)) + 1
    rows = usable.select(
        F.col(lang).alias("_l"), F.xxhash64(F.col(key)).alias("_h"), F.col(key).alias("_k"),
        F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(1), F.col(key)), spare) + 1).cast("int"), F.lit(passage)).alias("_p"),
    )
    order = Window.partitionBy("_l").orderBy("_h", "_k", "_p")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("_l", "_n", "_p").toArrow().to_pydict()
    out: dict[str, list] = {}
    for name, n, p in sorted(zip(chosen["_l"], chosen["_n"], chosen["_p"], strict=True)):
        out.setdefault(name, []).append((n, plain(p)))
    return {name: _BREAK.join(p for _, p in parts) for name, parts in out.items() if any(p for _, p in parts)}


def languages(docs: DataFrame, samples: dict[str, str], key: str = "doc_id", text: str = "text", together: int = TOGETHER) -> DataFrame:
    """key, lang_pred, score of each row."""
    blocks = [tuple(sorted(samples.items())[i : i + together]) for i in range(0, len(samples), together)] or [()]
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    shape = f"_k {kind}, _t string, _two array<struct<e:double,l:string>>"

    def told_by(sent):
        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = automata(sent.value)
            for batch in batches_of(batches, "_t"):
                plains = [plain(t) for t in batch.column("_t").to_pylist()]
                held = [[(h["e"], h["l"]) for h in two] for two in batch.column("_two").to_pylist()]
                found = [best_two(t, known, h) if t and (known or h) else h for t, h in zip(plains, held, strict=True)]
                two = pa.array([[{"e": e, "l": name} for e, name in f] for f in found], batch.column("_two").type)
                yield pa.record_batch([batch.column("_k"), batch.column("_t"), two], ["_k", "_t", "_two"])

        return tell

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.expr("cast(array() as array<struct<e:double,l:string>>)").alias("_two"))
    for block in blocks:
        rows = rows.mapInArrow(told_by(spark.sparkContext.broadcast(block)), shape)
    first, second = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    score = F.when(second.isNull(), 1.0).otherwise(second["e"] / (first["e"] + second["e"]))
    return rows.select(F.col("_k").alias(key), F.coalesce(first["l"], F.lit(UNKNOWN)).alias("lang_pred"), F.when(first.isNull(), 0.0).otherwise(score).alias("score"))


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score of every document, learned from rows that are not held out."""
    told = languages(docs, learned(docs, key, text, lang), key, text)
    return told.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
