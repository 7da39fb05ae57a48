"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

Tier one is a compact table of the corpus's frequent words and their token counts, built from a bounded
sample of documents and broadcast. Tier two is each worker's cache of the words it met besides; words in
neither are encoded by the tokenizer library. Both tiers only save time: every count is
the library's, so results don't depend on the sample or on the cache.

A text is cut at white space first, which this tokenizer drops before it splits into pre-tokens, so counts
of words add up. That holds for texts in plain characters (``PLAIN``: where Python and the library agree
on white space, letter case and composed characters) without special-token strings; any other text goes to
the library whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); empty tables give empty results; repeated
rows and null ids are rows like any other; extra columns pass through and lose to the added names.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, prepare

#: Letters, digits and punctuation of Latin-1 and Latin Extended-A, general punctuation, and the four usual white spaces.
PLAIN = re.compile("[\t\n\r -~¡-¬®-įĲ-ňŊ-ž‐-‧‰-⁞€]*")
#: Documents sampled for tier one, bytes read of each batch of them, and the words kept (about 20 bytes each).
SAMPLE_ROWS, TABLE_WORDS = 2_000, 32_768
#: Characters of a piece of a long text: pieces end at white space, and bound a worker's lists.
PIECE = 1 << 20


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(text: str):
    """The words of each piece; a piece ends where a white space is."""
    if len(text) <= PIECE:
        yield text.split()
        return
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to].split()
        at = to


def plain(text: str, special: tuple[str, ...]) -> bool:
    return PLAIN.fullmatch(text) is not None and not any(s in text for s in special)


def frequent_words(docs: DataFrame, text: str, rows: int, words: int) -> list[str]:
    """Tier one: the most frequent words of a bounded sample; each task sends its own most frequent ones."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for some in pieces(value):
                    seen.update(some)
        top = seen.most_common(words)
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": pa.array([n for _, n in top], pa.int64())})

    sample = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").where(F.pmod(F.xxhash64("t"), F.lit(16)) == 0).limit(rows)
    found = sample.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.orderBy(F.desc("n"), "word").limit(words).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text: str = "text", limit: int = 2048,
                 sample_rows: int = SAMPLE_ROWS, table_words: int = TABLE_WORDS, cache_words: int = 600_000) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    spark = prepare(docs.sparkSession).sparkContext
    names = ("n_bytes", "n_tokens", "over_limit")
    frequent = frequent_words(docs, text, sample_rows, table_words)
    lengths = [len(e) for e in load(tokenizer_path).encode_batch_fast(frequent, add_special_tokens=False)] if frequent else []
    shared = spark.broadcast(("\n".join(frequent), bytes(min(n, 255) for n in lengths)))  # one byte a length; 255: look again

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        tokenizer = load(tokenizer_path)
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        joined, packed = shared.value
        first = {w: n for w, n in zip(joined.split("\n"), packed, strict=False) if n < 255}
        cache = Memo(lambda w: len(tokenizer.encode(w, add_special_tokens=False)), cache_words)

        def of_words(words) -> int:
            found = list(map(first.get, words))
            total = sum(n for n in found if n is not None)
            return total + sum(cache[w] for w, n in zip(words, found, strict=True) if n is None)

        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            tokens = []
            for scalar in values:
                t = scalar.as_py() or ""
                if plain(t, special):
                    tokens.append(sum(map(of_words, pieces(t))))
                else:
                    tokens.append(len(tokenizer.encode(t, add_special_tokens=False)))
            sizes = pc.fill_null(pc.binary_length(values), 0).cast(pa.int64())
            n = pa.array(tokens, pa.int64())
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, sizes, n, pc.greater(n, limit)], names=[*batch.schema.names[:-1], *names])

    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*kept, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(lean(count), schema)
