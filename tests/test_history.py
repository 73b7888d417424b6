"""The ordered history in chunks, and in one row within a bound."""

import pytest
from pyspark.sql import functions as F

from cohortlens.config import DEFAULT
from cohortlens.operators import ordered, sequence
from cohortlens.plans import reports
from conftest import D, make_tables, user

KINDS = ["Vaccination", "Telehealth Consultation", None, "Medication Support"]


@pytest.fixture(scope="module")
def third(spark):
    """User 1 has a third of all services, many on one day; user NULL has some."""
    rows = [(1, k, D(f"20{10 + k // 60:02d}-{1 + k // 5 % 12:02d}-01"), None, 1.0, KINDS[k % 4], f"c{k % 7}") for k in range(400)]
    rows += [(2 + k % 90, 1000 + k, D(f"2020-01-{1 + k % 28:02d}"), None, 1.0, KINDS[k % 3], "c") for k in range(780)]
    rows += [(None, 5000 + k, D(f"2021-03-{1 + k:02d}"), None, 1.0, "Vaccination", "c") for k in range(20)]
    return make_tables(spark, users=[user(u) for u in range(95)], services=rows)


def expected(rows, size):
    out = {}
    for r in rows:
        out.setdefault((r.User_ID, (r.Position - 1) // size), []).append((r.Position, r.ServiceType, r.ServiceStartDate))
    return {k: [v[1:] for v in sorted(vs, key=lambda v: v[0])] for k, vs in out.items()}


@pytest.mark.parametrize("size,hot", [(7, False), (7, True), (1000, True), (1, False)])
def test_chunks_hold_the_history_in_order(spark, third, monkeypatch, size, hot):
    if hot:  # user 1 is split over parts
        monkeypatch.setattr(ordered, "HOT_ROWS", 100)
        monkeypatch.setattr(ordered, "ROWS_PER_PART", 50)
    seq = sequence.service_sequence(third.services).cache()
    want = expected(sequence.history_rows(seq).collect(), size)
    got = sequence.history_chunks(seq, DEFAULT.with_(history_chunk=size)).collect()
    assert {(r.User_ID, r.Chunk): [tuple(x) for x in r.Service_Types] for r in got} == want
    assert all(r.First_Position == r.Chunk * size + 1 and r.Services == len(r.Service_Types) <= size for r in got)
    whole = {r.User_ID: [tuple(x) for x in r.All_Service_Types]
             for r in sequence.history_arrays(seq, DEFAULT.with_(history_chunk=size)).collect()}
    assert whole == {u: [x for k in sorted(k for v, k in want if v == u) for x in want[u, k]] for u, _ in want}
    summary = {r.User_ID: r for r in sequence.service_summary(seq, DEFAULT.with_(history_chunk=size)).collect()}
    assert {u: [tuple(x) for x in r.All_Service_Types] for u, r in summary.items()} == whole
    seq.unpersist()


def test_one_row_beyond_the_bound_fails_loudly(spark, third):
    bound = DEFAULT.with_(history_limit=100, history_chunk=10)
    with pytest.raises(Exception, match="user 1 has .* services, more than history_limit=100"):
        reports.churn_table(third, bound).collect()
    # without the array the same tables are no trouble, and neither are the chunks
    table = reports.churn_table(third, bound, reports.churn_parts(third, bound, history=False))
    assert "All_Service_Types" not in table.columns and table.count() == 95
    assert sequence.history_chunks(sequence.service_sequence(third.services), bound).where("User_ID = 1").count() >= 10


def test_no_list_over_a_user(spark, third):
    plan = sequence.history_chunks(sequence.service_sequence(third.services))._jdf.queryExecution().optimizedPlan().toString()
    group = plan[plan.index("Aggregate ["):].splitlines()[0]
    assert "collect_list" in group and group.partition("], [")[0].count(",") == 1   # (user, chunk)
    assert third.services.where(F.col("User_ID") == 1).count() * 3 >= third.services.count()
    assert sequence.history_chunks(sequence.service_sequence(third.services.limit(0))).count() == 0
