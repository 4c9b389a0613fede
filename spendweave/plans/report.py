"""Report data set: one filtered list, read by every section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from spendweave.operators import aggregates, families
from spendweave.operators.current import supplier_list
from spendweave.operators.filters import SupplierFilter, supplier_filter
from spendweave.operators.review import low_confidence_rows
from spendweave.params import Params
from spendweave.session import cut
from spendweave.sources import reports


@dataclass
class Report:
    metadata: DataFrame
    summary: DataFrame
    segments: DataFrame
    rollup: DataFrame
    top_parents: DataFrame
    review: DataFrame
    rows: DataFrame
    members: DataFrame
    rollup_mode: str

    def hierarchy(self) -> DataFrame:
        return reports.hierarchy_export(self.members, families.clusters(self.members))

    def write(self, path: str, verbose: bool = False) -> list[str]:
        sections = {
            "suppliers": reports.supplier_export(self.rows, verbose), "segments": reports.segment_section(self.segments),
            "rollup": reports.rollup_section(self.rollup), "review": reports.review_section(self.review), "hierarchy": self.hierarchy(),
        }
        return reports.write_report(sections, self.metadata, path, self.rollup_mode)


def build_report(suppliers: DataFrame, history: DataFrame, taxonomy: DataFrame, params: Params, wanted: SupplierFilter = SupplierFilter(), name: str = "Spend report", made_by: str = "job") -> Report:
    """Families are built on the filtered rows, so a parent filtered out leaves its child on its own."""
    rows, _ = cut(supplier_filter(supplier_list(suppliers, history, taxonomy), wanted, params, registry=suppliers))
    members = families.family_members(rows)
    summary = aggregates.report_summary(rows, params)
    rollup = families.parent_rollup(members, params)
    return Report(
        metadata=reports.report_metadata(summary, name, params.as_of, made_by, params.taxonomy_version, wanted.rollup, wanted.describe()),
        summary=summary, segments=aggregates.segment_breakdown(rows), rollup=rollup, top_parents=families.top_parents(rollup),
        review=low_confidence_rows(rows, params), rows=aggregates.parent_labels(rows), members=members, rollup_mode=wanted.rollup,
    )
