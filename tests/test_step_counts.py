"""Steps counted while results are written."""

from pyspark.sql import functions as F

from checks.fixtures import Data
from recordloom.operators import audit
from recordloom.plans import cases, loads
from recordloom.session import scratch_path, stage

SF_DIR = "/root/testdata/sf0.001"


def test_published_steps_are_counted_by_the_write(spark):
    d = Data(spark, SF_DIR)
    source = stage(d.src(), "src")
    counter = audit.StepCounter()
    tables = cases.publish(source, d.ct(), scratch_path(spark, "published"), counter)
    counts = counter.counts(spark)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan
    found = {r["step"]: r["row_count"] for r in counts.collect()}
    routed = cases.route(cases.label_with_lookup(source, d.ct()))
    assert found == {
        "source_data": source.count(), "labelled": routed.count(), "civil": routed.where("subtype in ('D', 'E', 'PE', 'PD', 'PE, PD', 'PD, PE')").count(),
        "accepted": routed.where("branch = 'A'").count(), **{name: df.count() for name, df in tables.items()},
    }
    plain = cases.publish(source, d.ct(), scratch_path(spark, "plain"))
    assert all(plain[n].exceptAll(tables[n]).isEmpty() and tables[n].exceptAll(plain[n]).isEmpty() for n in tables)


def test_new_cases_are_counted_as_they_are_staged(spark):
    d = Data(spark, SF_DIR)
    source = stage(d.src(), "src")
    none = loads.accept_cases(source, d.ct()).where(F.lit(False))
    counter = audit.StepCounter()
    first, _, _ = loads.process_loads(source, d.ct(), none, [1, 2, 3], counter=counter)
    found = {r["step"]: r["row_count"] for r in counter.counts(spark).collect()}
    rows = source.where("load_id in (1, 2, 3)")
    assert found["load_rows"] == rows.count() and found["new_cases"] == found["first_rows"] == first.count() > 0
    assert found["accepted"] == loads.accept_cases(rows, d.ct()).count()
    again = audit.StepCounter()
    loads.process_loads(source, d.ct(), stage(first, "cases"), [1, 2, 3], counter=again)
    assert {r["step"]: r["row_count"] for r in again.counts(spark).collect()}["new_cases"] == 0
