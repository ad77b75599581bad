"""BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

1. All words of all texts are counted; the most frequent are the lexicon, `size` at most, a documented bound (words of
   about the same count are in it together or not at all). Rarer words are never left out: they are merged where they occur.
2. The driver merges the lexicon's words once, compiles them with their ids into a minimal acyclic automaton, and
   hands the file to the executors, which memory-map it; an executor that joins later fetches it again.
3. Texts are encoded group by group (see pieces): a group's different words get their ids from the automaton, or else by
   the vocabulary's merges, and a text's ids are those of its words.

Nothing but the rows of the counts is shuffled; texts stay where they are. A null or empty text has no ids and decodes
to the empty text. Extra columns, null ids and repeated rows are kept as they are; an empty table has an empty result.
A text's ids are those of the tokenizers library without special tokens being added; special tokens in a text get
their ids. Decoding joins the tokens by one blank, as the library does for a vocabulary without a decoder.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import Kept, mapped, shared_dir, written
from .lexicon import Lexicon, build
from .pieces import Encoder, Splitter, Values, gathered, in_groups

LEXICON_SIZE = 65_536


def count_words(texts: DataFrame, tokenizer: str, most: int = 100_000) -> DataFrame:
    """(word, n): every word of column `text` of all rows, in byte letters. Tasks count `most` words or so before the shuffle."""

    def count(batches):
        split = Kept.get(tokenizer, lambda: Splitter(tokenizer))
        total: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for texts in in_groups([t for t in batch.column("text").to_pylist() if t]):
                group = split.group(texts)
                for w, n in zip(group.words, group.counts().tolist(), strict=True):
                    total[w] = total.get(w, 0) + n
                if len(total) > most:
                    yield out()
                    total = {}
        yield out()

    return mapped(texts.select("text"), count, "word string, n long", "bpe-count").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_SIZE) -> str:
    """The name of a file that SparkFiles.get finds on every executor."""
    spark = docs.sparkSession
    # a word longer than this is not worth a path of its own, however frequent: it is merged where it occurs
    counts = written(count_words(docs, tokenizer).filter(F.length("word") <= 64), "word-counts")
    # a histogram of at most some thousand rows tells from which count on the words are `size` at most; only those are collected
    cell = F.floor(F.log("n") * 64).cast("int")
    least, total = 0, 0
    for at, n in sorted(counts.groupBy(cell.alias("cell")).count().collect(), reverse=True):
        total += n
        if total > size:
            least = at + 1
            break
    by_bytes = sorted((r[0].encode(), r[0]) for r in counts.filter(cell >= least).select("word").collect())
    name = f"lexicon-{uuid.uuid4().hex}.bin"  # a name is given out once in a session
    out = files.Committed(shared_dir(spark), name)
    out.write(build([b for b, _ in by_bytes], Encoder(Splitter(tokenizer))([w for _, w in by_bytes])))
    out.commit()
    spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")
    return name


def encoder(tokenizer: str, lexicon: str, strings: bool) -> tuple[Splitter, Values]:
    """Words and their values (ids, decimals, tokens): ids as little-endian bytes and, if asked for, in decimal and as tokens, each joined by one blank."""
    split, known = Splitter(tokenizer), Lexicon(SparkFiles.get(lexicon))
    merged = Encoder(split)
    tokens = {i: t.encode() for t, i in split.tokenizer.get_vocab().items()}
    decimals = {i: b"%d" % i for i in tokens}

    def fill(ws: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        numbers = known.numbers([w.encode() for w in ws]).tolist()
        unseen = iter(merged([w for w, k in zip(ws, numbers, strict=True) if k < 0]))
        out = []
        for k in numbers:
            ids = known.outputs(k) if k >= 0 else next(unseen)
            both = (b" ".join(map(decimals.__getitem__, ids)), b" ".join(map(tokens.__getitem__, ids))) if strings else (b"", b"")
            out.append((array("I", ids).tobytes(), *both))
        return out

    return split, Values(fill)


#: What `encode` can add to a row.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def outputs_of(texts: list[str], split: Splitter, values: Values, outputs: tuple[str, ...]) -> list[pa.Array]:
    group = split.group(texts)
    found = values.of(group.words)
    ids, upto = gathered([v[0] for v in found], group)
    made: dict[str, pa.Array] = {
        "ids": pa.ListArray.from_arrays(pa.array(np.append(0, upto).astype(np.int32)), pa.array(ids.astype(np.int32))),
        "n_tokens": pa.array(np.diff(upto, prepend=0), pa.int64()),
    }
    for at, whole, digest in ((1, "", "ids_sha256"), (2, "decoded", "decoded_sha256")):
        if whole in outputs or digest in outputs:
            of_word = [v[at] for v in found]
            rows = [b" ".join(map(of_word.__getitem__, group.codes[a:b].tolist())) for a, b in zip([0, *group.ends.tolist()], group.ends.tolist(), strict=False)]
            made[whole] = pa.array([r.decode() for r in rows], pa.string()) if whole in outputs else None
            made[digest] = pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())
    return [made[o] for o in outputs]


def encode(docs: DataFrame, tokenizer: str, keep: list[str], outputs: tuple[str, ...] = ("ids", "decoded"), size: int = LEXICON_SIZE) -> DataFrame:
    """Columns `keep` of docs, and `outputs` (of OUTPUTS) of its column text. An output replaces a kept column of its name."""
    lexicon = compile_lexicon(docs, tokenizer, size)
    keep = [c for c in keep if c not in outputs]
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(docs["text"], F.lit("")).alias("text"))
    strings = not set(outputs) <= {"ids", "n_tokens"}
    names = [*(f"k{i}" for i in range(len(keep))), *(f"o{i}" for i in range(len(outputs)))]

    def work(batches):
        split, values = Kept.get((tokenizer, lexicon, strings), lambda: encoder(tokenizer, lexicon, strings))
        for batch in batches:
            at = 0
            for texts in in_groups(batch.column("text").to_pylist()):
                # a batch for each group: what is held at once does not grow with the rows of a batch
                kept = [batch.column(f"k{i}").slice(at, len(texts)) for i in range(len(keep))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, *outputs_of(texts, split, values, outputs)], names)

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"o{i} {OUTPUTS[o]}" for i, o in enumerate(outputs))])
    return mapped(rows, work, schema, "bpe-encode").toDF(*keep, *outputs)
