"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the input folder and BENCH_CPUS the number of local cores. Every query starts
from the source tables' derived stores, whose build is timed as its own entry.
"""

import json
import os
import time

from vitalcells.registry import QUERIES
from vitalcells.registry.base import workspace
from vitalcells.session import local_session

HEADLINE = (
    "a01_load_region", "a05_inventory", "a13_profile_csv", "c03_cascade", "c08_variant_cascade",
    "c14_inclusion_groups", "d02_sample_sizes", "e02_missingness", "e03_exposure_codes",
    "e05_weeks_range", "e09_table1", "e10_table1_national", "e11_prevalence",
    "e15_missing_by_group", "e16_included_vs_excluded", "e17_exposure_missing_grid",
    "f07_top_states", "f09_long_to_wide", "h01_logistic_m5_margins", "h05_ladder_effects",
    "h08_or_vs_rr_effects", "h09_standardised_m5", "h10_coding_effects", "h11_interaction_test",
    "h12_stratified_effects", "h13_temporal_effects", "h14_last_year_effects",
    "h15_singleton_effects", "h16_prenatal_effects", "h17_national_effects",
    "h18_national_cluster", "h19_national_yearly_effects", "h20_variant_effects",
    "h21_other_education_effects", "i01_revised_table2", "i02_reconciliation",
    "i03_consolidated_numbers", "r02_tier",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    space = workspace(spark, folder)
    timed("build_births_raw", lambda: space.raw)
    timed("build_cohort", lambda: space.cohort)
    timed("build_cells", lambda: space.run())
    timed("build_yearly_files", lambda: space.files)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
