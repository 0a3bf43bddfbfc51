"""Token counts as additive rollups that signed changes keep current."""

from __future__ import annotations

import base64
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
#: How the byte-level vocabularies split texts before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_BLANK = 1000
#: Fixed value: the characters that the split rule takes for white space.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)


def encoder(path: str, pattern: str = SPLIT):
    """The tokenizer of a rank file, a line for each token: its bytes in base 64 and its rank."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(encoding):
    """A function that counts the tokens of a text, whatever runs of white space it has.

    The split rule steps back through white space to leave its last character to the word behind, for which
    its engine has no room in runs of a million. A long run is cut out: all but its last character is one piece
    by that rule (all of it where the text ends), and is merged as such; the rest is what it would be.
    """

    def count(text: str) -> int:
        n, begin = 0, 0
        for run in BLANKS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            n += len(encoding.encode_ordinary(text[begin : run.start()]))
            n += len(encoding._core_bpe.encode_single_piece(text[run.start() : stop].encode()))
            begin = stop
        return n + len(encoding.encode_ordinary(text[begin:]))

    return count


def count_tokens(docs: DataFrame, text_col: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Append the number of tokens of each whole text; a null or empty text has none, and texts and runs of one
    character may be of any length.

    The vocabulary file is read by the tasks and must be at the same path on all machines.
    """
    docs = docs.drop(out)
    keep = docs.columns
    at = keep.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def count(batches):
        tokens_of = None
        for batch in batches:
            tokens_of = tokens_of or counter(encoder(vocabulary))
            n = [0 if text is None else tokens_of(text) for text in (v.as_py() for v in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*keep, out])

    return docs.mapInArrow(count, f"{schema}, `{out}` long")


def change(sign: int, tokens: Column, source: Column, lang: Column, tokenizer: Column) -> Column:
    return F.struct(
        source.alias("source"), lang.alias("lang"), tokenizer.alias("tokenizer"), F.lit(sign).cast("long").alias("docs"),
        (sign * tokens).cast("long").alias("tokens"),
    )


def inserted(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return _changes(rows, [change(1, F.col(tokens), *map(F.col, KEYS))])


def deleted(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return _changes(rows, [change(-1, F.col(tokens), *map(F.col, KEYS))])


def revised(rows: DataFrame, old: str = "old_tokens", new: str = "tokens") -> DataFrame:
    """A revised count takes back the old one and adds the new one."""
    return _changes(rows, [change(-1, F.col(old), *map(F.col, KEYS)), change(1, F.col(new), *map(F.col, KEYS))])


def _changes(rows: DataFrame, parts: list[Column]) -> DataFrame:
    return rows.select(F.inline(F.array(*parts)))


@dataclass
class Rollup:
    """Totals by source, language and tokenizer version, kept as one small delta table for each batch.

    A batch is summed, written under a name of its own, and becomes part of the totals when its commit
    file, named by the batch id and created only if absent, names that table. A batch that comes again,
    or that a second writer committed first, changes nothing; a writer that dies before the commit
    leaves a table that no commit names.
    """

    spark: SparkSession
    folder: str

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> dict[str, str]:
        """The delta table of each committed batch."""
        path, files = self._files()
        top = path(f"{self.folder}/commits")
        if not files.exists(top):
            return {}
        out = {}
        for status in files.listStatus(top):
            stream = files.open(status.getPath())
            try:
                name = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if name:
                out[status.getPath().getName()] = name
        return out

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (source, lang, tokenizer, docs, tokens); False if it was there already.

        Changes are summed before they are shuffled, so a source with most rows sends one row a task. An
        empty batch is committed too. Keys may be null; keys whose sums are zero stay out of the delta.
        """
        path, files = self._files()
        commit = path(f"{self.folder}/commits/{batch_id}")
        if files.exists(commit):
            return False
        name = f"delta-{uuid.uuid4().hex}"
        delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.where("docs <> 0 OR tokens <> 0").write.parquet(f"{self.folder}/{name}")
        try:
            stream = files.create(commit, False)
        except Exception as e:
            if files.exists(commit):
                return False
            raise e
        stream.write(bytearray(name.encode()))
        stream.close()
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens now, by key; keys that deletes have emptied are left out."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        tables = [f"{self.folder}/{name}" for name in self.commits().values()]
        rows = self.spark.read.schema(schema).parquet(*tables) if tables else self.spark.createDataFrame([], schema)
        out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 OR n_tokens <> 0")
