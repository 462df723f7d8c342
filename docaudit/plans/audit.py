"""The whole audit as one plan: text -> elements -> findings -> verified findings -> reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.operators import review, rules, units
from docaudit.sources import paragraphs as P
from docaudit.sources.shared import persisted, removed


@dataclass(frozen=True)
class Audit:
    """Frames of an audit. Marked elements are written once, and all else is computed from them when it is read."""

    elements: DataFrame
    candidates: DataFrame
    verified: DataFrame
    docs: DataFrame
    options: frozenset[str]
    notes: DataFrame | None = None
    extra: tuple[rules.Rule, ...] = ()

    def passed(self) -> DataFrame:
        return review.passed_checks(self.candidates, self.elements, set(self.options), self.notes, self.extra)

    def report(self) -> DataFrame:
        return review.report_lines(self.verified, self.docs, self.passed(), set(self.options))

    def done(self) -> None:
        """Delete the marked elements, when nothing of this audit will be read any more."""
        removed(self.elements)

    def summary(self) -> DataFrame:
        return review.summary(self.verified, self.docs, set(self.options))

    def patterns(self) -> DataFrame:
        return review.global_patterns(self.verified)


def audit(docs: DataFrame, options: set[str] | None = None, kind: str = "markdown", text_col: str = "text", extra: tuple[rules.Rule, ...] = ()) -> Audit:
    """docs: doc_id and text. One shuffle by doc_id serves every window of the elements; the marked elements, with
    their findings but without their texts, go to the shared folder when the audit is made. extra: rules of one's own."""
    options = review.FULL if options is None else options
    rows = P.identified(P.sections(P.elements(docs, kind, text_col)))
    marked = persisted(rules.marked(rows, options, kind, extra), "marked")
    found = units.demoted(rules.candidates(marked, options), F.col("is_direct_quote"))
    found = review.numbered(found)
    return Audit(marked, found, review.verified(found), docs, frozenset(options), extra=extra)


# Fixed value: text changed by id so that every rule has something to find; the same expression runs in DuckDB.
INJECTED = """CASE CAST(doc_id % 12 AS INT)
 WHEN 0 THEN replace(text, ', ', ' ,')
 WHEN 1 THEN replace(text, '. ', '.  ')
 WHEN 2 THEN replace(text, '. ', ' ) ')
 WHEN 3 THEN replace(text, '. ', ' ( ')
 WHEN 4 THEN replace(text, 'e ', 'е ')
 WHEN 5 THEN '„' || text || chr(10) || 'Crossed ([) here] and URL http://example.org/p(a)) end http://example.org/' || repeat('long', 30)
 WHEN 6 THEN text || chr(10) || 'See https://example.org/a(b)), or http://example.org/' || CAST(doc_id AS STRING) || '.'
 WHEN 7 THEN '1. alpha' || chr(10) || '2. beta' || chr(10) || '4. gamma' || chr(10) || text
 WHEN 8 THEN 'Opening....3' || chr(10) || 'Missing part....9' || chr(10) || '# Openings' || chr(10) || text || chr(10) || '# Closing' || chr(10) || '# After' || chr(10) || '#  ' || chr(10) || 'Some LOUD word'
 WHEN 9 THEN text || chr(10) || 'As (Petrov, 1999) shows.' || chr(10) || '# References' || chr(10) || 'Markov, Ana. A study of things. Nowhere' || chr(10) || 'Smith J., Title, Oxford University Press, 2015'
 WHEN 10 THEN text || chr(10) || 'τὸν Κάδμον ἐλθεῖν'
 ELSE text || chr(10) || 'x **bold** and `code` and [a](b)' END"""


def injected(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.expr(INJECTED).alias("text"))
