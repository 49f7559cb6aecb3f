"""An inverted index as tables: documents with their tokens, postings, statistics.

``domain`` is part of every key. Its base is one table with a row for each
document and its different terms (``packed``), so that a document is scored
where it lies; postings are its terms as rows. ``stored`` writes that table, so that many
searches share one tokenization; writing it takes no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trawl.functions import porter, text
from trawl.operators.packed import SCHEMA, lexicon_batches, pack_batches, posting_batches
from trawl.staging import staged

#: Bytes of a row group of a stored index.
ROW_GROUP = 32 << 20


@dataclass
class Index:
    """``rows``: domain, doc_id, len, and the packed terms, sizes, tfs of each document."""

    rows: DataFrame
    written: bool = False
    #: What was computed from a written index for later searches, by name.
    kept: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def docs(self) -> DataFrame:
        """domain, doc_id, len."""
        return self.rows.select("domain", "doc_id", "len")

    @property
    def postings(self) -> DataFrame:
        """domain, doc_id, len, term, tf."""
        out = StructType([self.rows.schema[n] for n in ("domain", "doc_id", "len")]).add("term", "string").add("tf", "double")
        return self.rows.mapInArrow(posting_batches, out)

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that ``make`` computes: once, and stored, if the index is."""
        if not self.written:
            return make()
        if name not in self.kept:
            self.kept[name] = staged(make(), name)
        return self.kept[name]

    def domains(self) -> DataFrame:
        """domain, n documents, avgdl, total tokens."""
        return self.docs.groupBy("domain").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), F.sum("len").alias("total"))

    def lexicon(self) -> DataFrame:
        """domain, term, df, cf."""
        return self.keep("lexicon", self._lexicon)

    def _lexicon(self) -> DataFrame:
        out = StructType([self.rows.schema["domain"]]).add("term", "string").add("df", "long").add("cf", "double")
        counted = self.rows.select("domain", "terms", "sizes", "tfs").mapInArrow(lexicon_batches, out)
        return counted.groupBy("domain", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def probabilities(self) -> DataFrame:
        """domain, term, cf and p(term | collection), never below 1e-12."""
        total = F.when(F.col("total") == 0, 1).otherwise(F.col("total"))
        return self.lexicon().join(self.domains(), "domain").select("domain", "term", "cf", F.greatest(F.col("cf") / total, F.lit(1e-12)).alias("p"))

    def stored(self) -> Index:
        """The same index from a written table, in row groups that readers share out."""
        return Index(staged(self.rows, "index", **{"parquet.block.size": ROW_GROUP}), True)


def tokens_of(corpus: DataFrame, tokenizer: text.Named) -> DataFrame:
    """domain, doc_id, len and term of every token; a document without tokens has one row with a null term."""
    made = corpus.select("domain", "doc_id", text.made_by(tokenizer, text.TOKENIZERS)(F.col("text")).alias("tokens"))
    return made.select("domain", "doc_id", F.size("tokens").cast("long").alias("len"), F.explode_outer("tokens").alias("term"))


def build(corpus: DataFrame, tokenizer: text.Named = "simple") -> Index:
    """Index of ``corpus`` (domain, doc_id, text); the tokenizer is a name or a function from a text column to an array of terms."""
    if tokenizer in text.PLAIN:  # counted from the text itself
        return Index(_packed(corpus.select("domain", "doc_id", F.lower(text.given(F.col("text"))).alias("_x")), text.PLAIN[tokenizer]))
    tokens = corpus.select("domain", "doc_id", text.made_by(tokenizer, text.TOKENIZERS)(F.col("text")).alias("_x"))
    if tokenizer in text.STEMMED:
        stems = porter.with_stems(tokens_of(corpus, tokenizer).where("term IS NOT NULL")).groupBy("domain", "doc_id").agg(F.collect_list("term").alias("_x"))
        tokens = corpus.select("domain", "doc_id").join(stems, ["domain", "doc_id"], "left")
    return Index(_packed(tokens))


def _packed(docs: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Rows of documents with tokens, or a text, ``_x``: a row's terms are counted within the row, without a shuffle."""
    return docs.mapInArrow(lambda b: pack_batches(b, stop), StructType([docs.schema["domain"], docs.schema["doc_id"], *StructType.fromDDL(SCHEMA)]))


def query_terms(queries: DataFrame, tokenizer: text.Named, form: text.Named) -> DataFrame:
    """domain, query_id, term, qtf of ``queries`` (domain, query_id, text)."""
    tokens = queries.select("domain", "query_id", F.explode(text.made_by(tokenizer, text.TOKENIZERS)(text.made_by(form, text.FORMS)(F.col("text")))).alias("term"))
    if tokenizer in text.STEMMED:
        tokens = porter.with_stems(tokens)
    return tokens.groupBy("domain", "query_id", "term").agg(F.count("*").cast("double").alias("qtf"))
