"""Quality classifier: positive-unlabelled learning on what texts look like (see pu_learning)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowlens.llm.pu_learning import accepted, scored, train

THRESHOLD = 0.3
#: Chosen by cross_validate over the four learning folds of the sf0.1 tables (highest mean of both recalls): 1e-3 and 400
#: steps 0.9863, 1e-4 and 400 steps 0.9921, 1e-4 and 1,500 steps 0.9922. The test fold had no part in it.
L2 = 1e-4
STEPS = 1_500


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs`` (``doc_id, text``).

    Trusted positives are the texts with ``labels.quality`` 1 outside the test fold. Only the text is scored, whole; null and
    empty texts get the score of a text without characters. Rows with equal ids are scored each by its own text.
    Null or contradicting labels: a null one is ignored, an id with any label 1 is trusted. Without labels every score is 0.5.
    """
    return scored(docs, train(docs, labels, "quality", style=True, words=False, l2=L2, steps=STEPS, **how), THRESHOLD)


def good_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    return accepted(docs, train(docs, labels, "quality", style=True, words=False, l2=L2, steps=STEPS, **how), THRESHOLD)
