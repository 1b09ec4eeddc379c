"""Extensions of the analysis: what a caller registers beside the built-in rules.

Everything registered is a rule row or a function from DataFrames to DataFrames,
so an extension is planned by Catalyst like the rest; nothing runs at registration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import asking, extract
from loomwork.sources import records

Table = Callable[[DataFrame], DataFrame]


def _named(known: dict, name: str, value) -> None:
    if name in known:
        raise ValueError(f"{name} is registered already")
    known[name] = value


@dataclass
class Extensions:
    """Language adapters, ecosystem detectors, enrichment, coverage formats, scorers and a question classifier."""

    languages: dict[str, tuple[list[str], Table]] = field(default_factory=dict)
    detectors: dict[str, tuple] = field(default_factory=dict)
    enrichers: dict[str, Table] = field(default_factory=dict)
    coverage: dict[str, Table] = field(default_factory=lambda: {"istanbul": records.istanbul, "line-lists": records.line_lists})
    scorers: dict[str, Callable[[DataFrame, str], DataFrame]] = field(default_factory=dict)
    classifier: Callable[[str], list[str]] | None = None

    def language(self, name: str, extensions: list[str], facts: Table) -> Extensions:
        """An adapter: file extensions, and facts (path, line, fact, name, detail) of the files of the language."""
        _named(self.languages, name, ([e.lower() for e in extensions], facts))
        return self

    def detector(self, name: str, languages: list[str], category: str, signals: list[str]) -> Extensions:
        """An ecosystem detector in the form of the built-in ones."""
        _named(self.detectors, name, (name, ",".join(languages), category, signals))
        return self

    def enricher(self, name: str, enrich: Table) -> Extensions:
        """Further facts (path, line, fact, name, detail), such as a language service's, of sources."""
        _named(self.enrichers, name, enrich)
        return self

    def coverage_format(self, name: str, parse: Table) -> Extensions:
        """A parser of reports (report, json) to (report, path, line, hits)."""
        _named(self.coverage, name, parse)
        return self

    def scorer(self, name: str, score: Callable[[DataFrame, str], DataFrame]) -> Extensions:
        """A ranking (id, score) of documents for a question, fused with the lexical one."""
        _named(self.scorers, name, score)
        return self

    def identify(self, path: Column) -> Column:
        """The language of a path: a registered extension, the longest first, else the built-in rules."""
        own = sorted(((e, name) for name, (es, _) in self.languages.items() for e in es), key=lambda x: (-len(x[0]), x))
        return F.coalesce(*[F.when(F.lower(path).endswith(e), F.lit(name)) for e, name in own], extract.identify_language(path))

    def facts(self, sources: DataFrame) -> DataFrame:
        """Facts of the built-in analysis; a registered language's files go to its adapter, and enrichers add theirs."""
        names = list(self.languages)
        rest = sources.where(~F.col("lang").isin(names) | F.col("lang").isNull()) if names else sources
        parts = [extract.facts(rest), *[adapt(sources.where(F.col("lang") == name)) for name, (_, adapt) in self.languages.items()], *[enrich(sources) for enrich in self.enrichers.values()]]
        return reduce(DataFrame.unionByName, parts)

    def detect(self, sources: DataFrame) -> DataFrame:
        return extract.detect(sources, [*extract.DETECTORS, *self.detectors.values()])

    def line_hits(self, reports: DataFrame) -> DataFrame:
        """(path, line, hits) over all formats, the most hits of a line."""
        return reduce(DataFrame.unionByName, [parse(reports) for parse in self.coverage.values()]).groupBy("path", "line").agg(F.max("hits").alias("hits"))

    def intents(self, question: str) -> list[str]:
        """The registered classifier's intents that exist, else the built-in ones."""
        known = {*dict(asking.INTENTS), "definition", "generic"}
        said = [i for i in (self.classifier(question) if self.classifier else []) if i in known]
        return said or asking.classify(question)

    def retrieve(self, docs: DataFrame, question: str, id_col: str, text_col: str, *, limit: int = 20) -> DataFrame:
        """(id, score): the lexical ranking fused with every registered one."""
        rankings = [asking.lexical(docs, question, id_col, text_col), *[score(docs, question) for score in self.scorers.values()]]
        return asking.fuse(rankings, limit=limit)
