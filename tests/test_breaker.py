"""The breaker's streaks go on from batch to batch."""

from folioframe.plans import source_queries as sq
from folioframe.plans.run_queries import steps

SF = "/root/testdata/sf0.001"


def walk(rows):
    """Steps that trip, one run after the other."""
    out = []
    for run in {r.run for r in rows}:
        failures = errors = tools = 0
        error = tool = None
        for r in sorted((r for r in rows if r.run == run), key=lambda r: r.event_id):
            if r.success:
                failures = errors = tools = 0
                continue
            failures += 1
            errors, error = (errors + 1 if r.error_code == error else 1), r.error_code
            if r.tool_name:
                tools, tool = (tools + 1 if r.tool_name == tool else 1), r.tool_name
            if failures >= 3 or errors >= 2 or (r.tool_name and tools >= 2):
                out.append((str(run), r.event_id, failures, errors, tools))
    return sorted(out)


def test_breaker_state_over_batches(spark, monkeypatch):
    drain, batches = sq._drain, []

    def watched(stream, spark, mode, keep_batch=False):
        out = drain(stream, spark, mode, keep_batch=True)
        batches.extend(r.batch for r in out.select("batch").distinct().collect())
        return out if keep_batch else out.drop("batch")

    monkeypatch.setattr(sq, "_drain", watched)
    got = sorted(map(tuple, sq.breaker_state(spark, SF).collect()))
    assert got == walk(steps(spark, SF).collect()) and len(got) > 10
    assert len(batches) >= 3
