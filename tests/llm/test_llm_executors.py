"""Every operator runs on workers that cannot import this package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver alone finds the package: workers have the environment and the folder they start in
from pyspark.sql import functions as F
from vitrine.session import get_session
spark = get_session("local[4]", 4)

@F.udf("string")
def found(_):
    try:
        import vitrine
        return "yes"
    except ImportError:
        return "no"

assert spark.range(4).select(found("id").alias("f")).distinct().collect()[0].f == "no"
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name in sys.argv[2:]:
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
        print(name, "ran")
"""
NAMES = ["op1_quality_classifier", "op2_exact_top_k", "op3_ngram_jaccard_join", "op4_main_text", "op5_mix_sources",
         "op6_quality_rules", "op7_token_counts", "op8_url_filter", "op9_best_fit_packing", "op10_language_id",
         "op11_token_alignment", "op12_suffix_dedup", "op13_vector_codes", "pipeline"]


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT, REPO, *NAMES], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=1200)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.split() == [w for n in sorted(NAMES, key=got.stdout.index) for w in (n, "ran")]
