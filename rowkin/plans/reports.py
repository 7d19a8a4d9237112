"""The data report: profiles, scripts, noise, landmarks and true pairs as one Markdown file.

    python -m rowkin.plans.reports TABLES REPORT.md
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rowkin.plans import queries_eval, queries_scan
from rowkin.session import build_session
from rowkin.sources.files import markdown_table

#: Title, query, columns that order the table (the query's own order where none are named) and rows shown.
SECTIONS = (
    ("Records by split and source", "eda_profile", ("split", "source"), 50), ("Records by country", "eda_countries", ("level", "split", "source", "country"), 400), ("First words of names", "eda_first_tokens", ("source", "place"), 120),
    ("Noise in names", "re_noise_flags", ("source",), 10), ("Noise in addresses", "re_address_flags", ("source",), 10), ("Landmark wordings", "re_landmarks", ("source",), 10), ("Dominant scripts by country", "eda_scripts", ("country", "script"), 300), ("Sets of scripts besides Latin", "eda_script_sets", (), 20),
    ("Words of names, one country", "eda_france", (), 60), ("Words of addresses, one country", "eda_address_tokens", (), 60), ("Candidates claimed by several records", "eda_exclusivity", ("source",), 10), ("Countries of true pairs", "eda_crosstab", ("country_s1", "country_cand"), 400), ("Matches per record", "eda_histogram", ("level", "country", "bucket"), 300),
    ("Matches per record and source", "eda_same_source", ("n2", "n3"), 40), ("Records without a match", "eda_distractors", ("level", "source", "country"), 300), ("Order of ids", "eda_spearman", (), 5), ("Examples of true pairs", "eda_pair_samples", ("s1_id", "cand_id"), 40),
)


def write_report(spark: SparkSession, tables: str, path: str) -> list[str]:
    """Write the report and return the titles of its sections; every table is computed over all rows, only what is shown is bounded."""
    queries = {**queries_scan.Q, **queries_eval.Q}
    parts = ["# Data report\n"]
    for title, name, order, limit in SECTIONS:
        df = queries[name](spark, tables)
        parts.append(f"## {title}\n\n" + markdown_table(df.orderBy(*order) if order else df, limit))
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(parts))
    return [s[0] for s in SECTIONS]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("tables")
    parser.add_argument("report")
    args = parser.parse_args(argv)
    print("\n".join(write_report(build_session(), args.tables, args.report)))


if __name__ == "__main__":
    main()
