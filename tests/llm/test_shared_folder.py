"""The shared folder where the session names none."""

import os
import subprocess
import sys
import textwrap


def test_operators_run_without_a_checkpoint_folder(tmp_path):
    code = textwrap.dedent(
        """
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        from tradewind.llm.common import shared_dir, staged
        from tradewind.llm.near_dedup import near_dedup
        assert staged(spark.range(3), "x").count() == 3 and shared_dir(spark) == shared_dir(spark)
        assert near_dedup(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
        """
    )
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": repo}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
