"""What the Python workers of the pipeline's stages hold."""

import subprocess
import sys

import numpy as np
import pyarrow as pa

from quillspark.llm import jaccard_join


def test_workers_of_the_pipeline_load_no_pandas():
    modules = "quillspark.llm.jaccard_join, quillspark.llm.decontamination, quillspark.llm.quality_rules, quillspark.llm.secret_scan, quillspark.llm.sentencepiece_codec"
    said = subprocess.run([sys.executable, "-c", f"import sys, {modules}; print('pandas' in sys.modules)"], capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "False"


def test_a_step_of_two_blocks_is_small():
    assert jaccard_join.CELLS * 8 <= 4 << 20


def test_counts_of_words_are_added():
    one, two = np.zeros(1 << jaccard_join.CHUNK_BITS, "<i8"), np.zeros(1 << jaccard_join.CHUNK_BITS, "<i8")
    one[3], two[3], two[5] = 1, 2, 4
    out = jaccard_join._added((pa.scalar(7), pa.scalar(0)), pa.table({"cells": pa.array([one.tobytes(), two.tobytes()], pa.binary())}))
    total = np.frombuffer(out["cells"][0].as_py(), "<i8")
    assert out["chunk"].to_pylist() == [7] and out["part"].to_pylist() == [0]
    assert total[3] == 3 and total[5] == 4 and total.sum() == 7
