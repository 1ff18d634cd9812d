"""Corpus pipeline: five stages over documents, each written and read again by its caller.

Every stage works on all rows its predecessor kept and returns the columns of
documents, the last adds ``piece_ids``. An empty table passes through empty.
Rows with a null id or a repeated id are rows like others; further columns pass
through all stages, whatever their names, but for names that begin with ``__``
and, in the last stage, ``piece_ids``, which is its result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import decontaminate, language_id, line_dedup, ngram_join, piece_codec
from sieveline.llm.common import materialize, table

#: A text whose best language has a lower mean probability is in none of those learned (four would give 0.25 each by chance).
LEAST_LANGUAGE_SCORE = 0.4


def _with_own(docs, added, step):
    """``step`` over ``docs`` with the columns that it would replace set aside under other names, and put back."""
    own = {c: f"__own_{c}" for c in docs.columns if c in added}
    return step(docs.withColumnsRenamed(own)), own


def language_stage(spark, docs, sf_dir):
    """Documents of a determined language, ``lang`` as given; null texts, texts without a letter, and texts that the network finds in no learned language go."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found, own = _with_own(docs, language_id.ADDED.names, lambda d: language_id.identify(d, model))
    kept = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def line_stage(spark, docs, sf_dir):
    """Texts without lines that match earlier ones, ``n_chars`` to suit; documents that lose every word go."""
    found = line_dedup.dedup_lines(docs)
    kept = found.filter((F.col("__lines_removed") == 0) | F.col("text").rlike(r"[^\x20\t-\r]"))
    size = F.when(F.col("__lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def copy_stage(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, 80 per cent): that of the smallest id; rows equal in id and text are one."""
    return ngram_join.first_copies(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark, docs, sf_dir):
    """Documents with the ids of their pieces."""
    rest = docs.drop("piece_ids")
    found, own = _with_own(rest, ["decoded"], piece_codec.encode)
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in rest.columns], "piece_ids")


STAGES: list = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", copy_stage),
    ("decontaminate", benchmark_stage),
    ("piece_codec", piece_stage),
]

#: The trained stage and the merging stage have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
