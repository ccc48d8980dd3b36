"""Properties over generated inputs."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.functions import text
from quillsift.operators import attempts, order

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(st.characters(exclude_categories=("Cs",)) | st.sampled_from("`\n\t \x1c\xa0 pythonPY\"\\{}"), max_size=40), min_size=1, max_size=40)


@FEW
@given(texts=TEXTS)
def test_scalars_match_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = rows.select("k", text.pystrip("s").alias("strip"), text.json_quote("s").alias("quoted"), text.unfence(text.fence("s", F.lit("python"))).alias("back")).orderBy("k").collect()
    for r, s in zip(got, texts):
        assert r.strip == s.strip() and r.quoted == json.dumps(s, ensure_ascii=False)
        assert "```" in s or s.strip().endswith("`") or s.strip().startswith("`") or r.back == s.strip()


@FEW
@given(flags=st.lists(st.booleans(), min_size=1, max_size=60), n=st.integers(1, 20))
def test_accepted_and_skipped_add_up(spark, flags, n):
    rows = spark.createDataFrame(list(enumerate(flags)), "k int, ok boolean")
    seen = order.post_limit(rows, "k", F.col("ok"), n).collect()
    ends = [k for k, f in enumerate(flags) if f]
    last = ends[n - 1] if len(ends) >= n else len(flags) - 1
    assert sorted(r.k for r in seen) == list(range(last + 1)) and sum(r.accepted for r in seen) == min(n, len(ends))


@FEW
@given(tries=st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=60))
def test_attempts_end_at_the_first_match(spark, tries):
    rows = spark.createDataFrame([(f"k{k}", n, ok) for n, (k, ok) in enumerate(tries)], "k string, n int, ok boolean")
    kept = sorted((r.k, r.n) for r in attempts.made(rows, "k", "n", F.col("ok")).collect())
    want = []
    for key in sorted({k for k, _ in tries}):
        for n, (k, ok) in enumerate(tries):
            if k == key:
                want.append((f"k{k}", n))
                if ok:
                    break
    assert kept == sorted(want)
