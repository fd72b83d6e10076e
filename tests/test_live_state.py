"""State of streams by buckets of keys: the same as key by key, in few calls to the store."""

import random

import pandas as pd
import pytest

from pressmill.streaming import state


class Store:
    """A handle that counts calls."""

    def __init__(self):
        self.calls, self.held = 0, None

    def getValueState(self, name, schema):
        return self if name == "deliveries" else Cell(self)

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1


class Cell(Store):
    def __init__(self, owner):
        self.owner, self.held = owner, None

    calls = property(lambda self: self.owner.calls, lambda self, n: setattr(self.owner, "calls", n))


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def table(ddl, rows):
    names, out = state._names(ddl), {}
    for name, kind in state._flagged(ddl).items():
        if name in names:
            values = [r[names.index(name)] for r in rows]
            out[name] = pd.Series([v or 0 for v in values] if kind == "bigint" else values, dtype={"bigint": "int64", "boolean": bool}.get(kind, object))
            if kind == "bigint":
                out[f"{name}_null"] = pd.Series([v is None for v in values], dtype=bool)
    return pd.DataFrame(out)


def plain(frame, ddl):
    return [{n: None if k == "bigint" and r[f"{n}_null"] else r[n] for n, k in (p.split() for p in ddl.split(", "))} for r in frame.to_dict("records")]


def ledger_rows(rng, jobs):
    words = [None, "queued", "running", "paused", "completed", "failed", "cancelled"]
    maybe = lambda x: rng.choice([None, x])
    return [(f"j{j}", k, rng.randrange(1, 9) * 1_000_000, maybe("b"), rng.choice(words), maybe(2**60 + k), maybe(k), maybe(1), maybe("e"), None) for j in range(jobs) for k in range(rng.randrange(1, 9))]


def test_jobs_of_a_bucket_fold_like_one_by_one():
    rng = random.Random(3)
    rows = ledger_rows(rng, 60) + [(None, 0, 1_000_000, None, "queued", None, None, None, None, None)]
    jobs = state.StoredTable(Store(), "folded", f"job_id string, {state._LATEST}, {state._STAMPS}").read()
    parts, got, folded = [[r for r in rows if r[1] <= 2], [r for r in rows if r[1] > 2]], [], {}
    for part in parts:
        rng.shuffle(part)
        steps, jobs = state.fold_steps(jobs, table(state._ROW, part))
        got += plain(steps[list(state._flagged(state._STEP))], state._STEP)
    want, latest = [], state._names(state._LATEST)
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        row = dict(zip(state._names(state._ROW), r))
        job = folded.setdefault(r[0], dict.fromkeys(latest + state._names(state._STAMPS)))
        before, at, status = job["status"], row["at_us"], row["status"]
        job |= {n: row[n] for n in latest if row[n] is not None}
        job["created_us"], job["updated_us"] = min(at, job["created_us"] or at), max(at, job["updated_us"] or at)
        if status == "running" and job["started_us"] is None:
            job["started_us"] = at
        if status == "paused":
            job["paused_us"] = at
        if status == "queued" and job["paused_us"]:
            job["resumed_us"] = at
        if status in ("completed", "failed", "cancelled"):
            job["completed_us"] = at
        want.append(row | {"previous_status": before if status else None} | {f"job_{n}": v for n, v in job.items()})
    key = lambda r: (str(r["job_id"]), r["ledger_seq"])
    assert sorted(got, key=key) == want and len(jobs) == len(folded)


@pytest.mark.parametrize("jobs", [3, 300])
def test_the_calls_for_a_bucket_of_jobs_do_not_grow_with_them(jobs):
    store, steps = Store(), state.JobSteps()
    steps.init(store)
    rows = ledger_rows(random.Random(1), jobs)
    assert not list(steps.handleInputRows((0,), iter([table(state._ROW, rows)]), Clock(0)))
    out = pd.concat(list(steps.handleExpiredTimer((0,), Clock(4_500), None)))
    assert len(out) == sum(r[2] < 4_500_000 for r in rows)
    out = pd.concat(list(steps.handleExpiredTimer((0,), Clock(60_000), None)))
    assert len(out) == sum(r[2] >= 4_500_000 for r in rows) and store.calls <= 12


@pytest.mark.parametrize("events", [3, 300])
def test_deliveries_of_a_bucket_settle_like_one_by_one(events):
    rng, store, limit = random.Random(7), Store(), 3
    work = state.Redelivery(limit)
    work.init(store)
    got, want, open_, settled = [], [], {}, {}
    for batch in range(3):
        told = []
        for e in range(events):
            for _ in range(rng.randrange(4)):
                status = rng.choice([None, 200, 404, 500])
                told.append((f"e{e}", "webhook", rng.randrange(1, 4), status, (batch * 10 + rng.random()) * 1e6 // 1, status == 200, status in (None, 500)))
        told = [(*r[:4], int(r[4]), *r[5:]) for r in told]
        now, before = batch * 10_000, store.calls
        got += [r for f in work.handleInputRows((0,), iter([table(state._TOLD, told)]), Clock(now)) for r in plain(f, state._DELIVERY)]
        got += [r for f in work.handleExpiredTimer((0,), Clock(now), None) for r in plain(f, state._DELIVERY)]
        assert store.calls - before <= 6
        for e, b, attempt, status, at, good, again in sorted(told, key=lambda r: (r[0], r[2], r[4])):
            if attempt <= max(settled.get(e, 0), open_.get(e, (0,))[0]):
                continue
            open_.pop(e, None)
            if good or not again or attempt >= limit:
                settled[e] = attempt
                want += [] if good else [(e, "dead", attempt, status, at)]
            else:
                open_[e] = attempt, status, at + 2**attempt * 1_000_000
        for e, (attempt, status, due) in list(open_.items()):
            if due < now * 1000:
                del open_[e]
                settled[e] = attempt
                want.append((e, "retry", attempt + 1, status, due))
    flat = lambda r: (r["event_id"], r["target"], r["attempt"], r["status"], r["due_us"])
    assert sorted(map(flat, got), key=str) == sorted(want, key=str)
