"""Queries of the operators for language-model text, by name; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillforge.llm import language, leakage, packing, pairs, residue, splitting, subjects, truncation
from quillforge.sources.tables import table


def students(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "student_translations")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: truncation.p1_found(students(s, d)),
        "p1_cut_share": lambda s, d: truncation.cut_share(students(s, d)),
        "p2_found": lambda s, d: residue.p2_found(students(s, d)),
        "p2_residue_share": lambda s, d: residue.residue_share(students(s, d)),
        "p3_found": lambda s, d: splitting.p3_found(table(s, d, "cycle")),
        "p3_pieces": lambda s, d: splitting.split_pool(table(s, d, "cycle")),
        "p3_piece_report": lambda s, d: splitting.piece_report(table(s, d, "cycle")),
        "p4_found": lambda s, d: pairs.p4_found(students(s, d), table(s, d, "cycle")),
        "p4_defect_counts": lambda s, d: pairs.defect_counts(students(s, d), table(s, d, "cycle")),
        "p5_found": lambda s, d: language.p5_found(students(s, d)),
        "p6_sequences": lambda s, d: packing.packed(table(s, d, "documents")),
        "p6_fill_report": lambda s, d: packing.fill_report(table(s, d, "documents")),
        "p6_token_rows": lambda s, d: packing.token_rows(table(s, d, "documents")),
        "p7_found": lambda s, d: leakage.p7_found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_leak_report": lambda s, d: leakage.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_found": lambda s, d: subjects.p8_found(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects")),
        "p8_composition": lambda s, d: subjects.composition(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects")),
        "p5_language_share": lambda s, d: language.language_share(students(s, d)),
    }


#: Unicode white space, spelled out for RE2.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others rest on trained models, alignment or a tokenizer."""
    return {"p3_found": f"select distinct order_idx from cycle where len(regexp_extract_all(source, '[^{SPACE}]+')) > 1280"}
