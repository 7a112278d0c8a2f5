import pytest

from weir.operators import reports as R
from weir.sources import trace as T
from weir.sources.trace import pack

MS = 1_000_000


def log():
    """A small log with one known answer for most reports."""
    out = [T.header("test", 0, 0), pack(T.NAME, pid=7, comm="waker")]
    t = 10**9
    for i in range(200):
        t += MS
        out += [pack(T.SCHED, op=R.WAKEUP, cpu=i % 2, pid=20 + i % 2, secondary=7, last_cpu=-1, ts=t), pack(T.SCHED, op=R.WAKE2RUN, cpu=i % 2, pid=20 + i % 2, secondary=-1, last_cpu=i % 2 if i % 10 else 1 - i % 2, runtime=20_000, ts=t + 20_000), pack(T.SCHED, op=R.PICK, cpu=i % 2, pid=20 + i % 2, secondary=-1, ts=t + 21_000)]
    out += [pack(T.SCHED, op=R.CPU_IDLE, cpu=3, sub=1, ts=10**9), pack(T.SCHED, op=R.WAKE2RUN, cpu=2, pid=30, secondary=-1, last_cpu=-1, runtime=5 * MS, ts=t + 6 * MS)]
    out += [pack(T.PROVIDER, ts=t, name="cache_topology", payload="\n".join(f'topo{{cpu="{c}",l2="{c // 2}",l3="0",socket="0"}} 1' for c in range(4)))]
    out += [pack(T.KSTRAND, tid=9, cpu=1, allowed=1, runtime=60 * MS, ts=t)]
    for i in range(5):
        out.append(pack(T.SCHED, op=R.KICK, cpu=i, pid=0, secondary=0, ts=t + i))
        if i:
            out.append(pack(T.SCHED, op=R.RESCHED, cpu=i, pid=0, secondary=0, ts=t + i + 4000))
    out += [pack(T.SCHED, op=R.ENQUEUE, cpu=0, pid=40 + k % 2, secondary=0, score=(8 << 48), ts=t) for k in range(4)]
    for i in range(1100):
        out.append(pack(T.NTSYNC, pid=1, tid=50, op=R.WAIT_ANY, fd=12, result=0, ts=t + i * 5000, wait_count=1, fds=[12], obj=5, objs=[5]))
    out += [pack(T.NTSYNC, pid=1, tid=51, op=R.WAIT_ANY, fd=10, result=-999, ts=t, wait_count=1, fds=[10], obj=6, objs=[6]), pack(T.NTSYNC, pid=1, tid=52, op=R.EVENT_SET, fd=10, obj=6, ts=t - 5)]
    out += [pack(T.IO, pid=1, tid=53, nr=202, fd=0, result=-999, count=0xF0, ts=t + 9 * MS), pack(T.IO, pid=1, tid=54, nr=7, fd=1, result=-999, ts=t), pack(T.IO, pid=1, tid=54, nr=0, fd=1, result=5, ts=t, dur=3 * MS)]
    out += [pack(T.SIGNAL, pid=1, tid=55, op=1, signal=11, exit_code=139, ts=t), pack(T.SIGNAL, pid=1, tid=55, op=0, signal=11, ts=t)]
    out += [pack(T.HEAP, pid=1, tid=60, op=R.MALLOC, addr=a, size=s, ts=t) for a, s in ((0x1000, 16), (0x2000, 32), (0x3000, 64))] + [pack(T.ABORT, pid=1, tid=60, line=3, ts=t, msg="m", loc="l")]
    out += [pack(T.HEAP, pid=1, tid=60, op=R.FREE, addr=0x1000, ts=t)] * 2 + [pack(T.HEAP, pid=1, tid=60, op=R.REALLOC, addr=0x2000, new_addr=0x9000, size=9, ts=t), pack(T.HEAP, pid=1, tid=60, op=R.FREE, addr=0x2000, ts=t)]
    out += [pack(T.KEYED, pid=1, tid=70, op=0, obj=77, ts=t), pack(T.STORM, interval_ms=100, kicks=10, preempt_kicks=1, reenq=9000, ts=t), pack(T.HEAPSTACK, pid=1, tid=1, op=0, depth=2, stack=[1, 2], ts=t)]
    out += [pack(T.SCHED, op=R.FIELD_GATE, cpu=0, pid=0, secondary=0, score=s, ts=t + k) for k, s in enumerate((1, 1, 2))]
    return b"".join(out)


WANT = {
    "summary": "EVENTS", "waits": "CONCENTRATED", "spins": "LIVELOCK", "pairing": "STUCK-SIGNALED", "doublefree": "LOGIC", "abortpm": "ABORT", "signals": "TEARDOWN-ONLY", "endstate": "STALLED", "iowait": "IOWAIT-PARKED",
    "heapstk": "HEAPSTACK", "futex": "FUTEX-PARKED", "keyedevt": "WEDGED", "sched": "FAST", "work-conservation": "CONSERVING", "placement-race": "PLACEMENT-MISS", "dispatch-stall": "PREEMPT-STARVED", "kick-latency": "UNANSWERED",
    "kstrand": "STRAND-HELD", "slice": "EVEN", "storm": "IDLE-REENQUEUE-CHURN", "service": "SKEWED", "wakers": "NO-HOT-WAKERS", "locality": "CACHE-LOCAL", "classmix": "CLASS-MIX", "field-persist": "LATCHED", "iolat": "IO", "seat": "NONE",
}
EMPTY = {"summary": "EMPTY", "waits": "NO-WAITS", "spins": "NONE", "sched": "NO-WAKE2RUN", "fractal": "NO-SCHED", "matrix-profile": "NO-PROFILE", "locality": "NO-TOPOLOGY", "placement-race": "NO-IDLE-STREAM", "endstate": "NO-THREADS"}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "a.mtk").write_bytes(log() + b"\x40\x00\x00\x00cut")
    e = T.read_traces(spark, str(d))
    p = str(tmp_path_factory.mktemp("ev")) + "/e"
    e.write.parquet(p)
    return spark.read.parquet(p)


def test_reader(events):
    assert events.count() == sum(1 for _ in T.records(log()))
    with pytest.raises(ValueError):
        list(T.records(b"x" * 100))


def test_classes(events):
    got = {r["report"]: r for r in R.run_reports(events).collect()}
    assert len(got) == 29
    assert {k: got[k]["class"] for k in WANT} == WANT
    g = {k: got[k]["gauges"] for k in got}
    assert g["kick-latency"]["kicks_unanswered"] == 1 and g["kick-latency"]["kicks_total"] == 5 and g["kick-latency"]["kick_resched_us_p50"] == 4
    assert g["abortpm"]["victim_bytes"] == 64 and g["doublefree"]["frees_total"] == 3 and g["doublefree"]["doublefree_total"] == 1
    assert g["sched"]["wake2run_us_worst"] == 5000 and g["locality"]["locality_tier_moves_0"] == 20 and g["iolat"]["iolat_p50_ms"] == 3
    assert all(r["class"] for r in got.values())


def test_empty(events):
    got = {r["report"]: r["class"] for r in R.run_reports(events.limit(0), list(EMPTY)).collect()}
    assert got == EMPTY


def test_renderings_and_golden(events):
    r = R.run_reports(events, ["iolat", "storm"])
    assert any('weir_iolat_worst_ms{report="iolat"} 3.0' == x.line for x in R.to_prometheus(r).collect()) and R.to_json(r).count() == 2
    assert all(x.ok for x in R.compare_golden(r, r).collect())


def delay(i):
    return 18 * MS if i % 1000 == 999 else 4 * MS if i % 100 == 99 else 2000 + i % 100 * 300


def known_log(idle=True):
    """The log whose classes and gauges FIXTURES.md (F2) lists; its numbers are fixed values."""
    out = [T.header("synthetic", 10**9, 0)] + [pack(T.NAME, pid=p, comm=c) for p, c in ((1000, "a"), (1001, "b"), (1002, "c"), (7, "d"))]
    put = lambda kind, **f: out.append(pack(kind, **f))

    def task(op, cpu, pid, ts, waker=-1, last=-1, **f):
        put(T.SCHED, op=op, cpu=cpu, pid=pid, secondary=waker, last_cpu=last, ts=ts, **f)

    t = 10**9
    for i in range(2000):
        t += 50_000
        cpu, pid, lat = i % 4, 1001 if i & 1 else 1002, delay(i)
        task(R.WAKEUP, cpu, pid, t, waker=1000)
        task(R.WAKE2RUN, cpu, pid, t + lat, sub=int(i % 3 == 0), runtime=lat)
        task(R.SWITCH_IN, cpu, pid, t + lat + 1000)
        if i % 7 == 0 and idle:
            task(R.CPU_IDLE, cpu, 0, t + lat + 2000, sub=1)
        task(R.PREEMPT_TICK, cpu, pid, t + 3000, runtime=9 * MS if i % 37 == 0 else 800_000 + i % 50 * 60_000, budget=MS)
    t += 100_000
    task(R.WAKE2RUN, 0, 7, t + 5 * MS, runtime=5 * MS)
    t += 100_000
    for k, (tid, cpu, ms) in enumerate(((801, 0, 60), (801, 0, 95), (802, 2, 140)), 1):
        put(T.KSTRAND, tid=tid, cpu=cpu, allowed=1, runtime=ms * MS, ts=t + k * MS)
    t += 100_000
    tiers = ((0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 1, 1))
    put(T.PROVIDER, ts=t, name="cache_topology", payload="".join(f'cpu_topology{{cpu="{c}",l2="{a}",l3="{b}",socket="{d}"}} 1\n' for c, (a, b, d) in enumerate(tiers)))
    t += 10_000
    path = (0, 1, 2, 3, 2, 1)
    for i in range(1, 36):
        t += 40_000 + i % 5 * 7000
        task(R.WAKE2RUN, path[i % 6], 1002, t, last=path[(i - 1) % 6], runtime=12_000)
    t += 100_000
    for i in range(12):
        t += 50_000
        task(R.KICK, i % 4, -1, t)
        if i % 5 != 4:
            task(R.RESCHED, i % 4, -1, t + 3000 + i % 4 * 1500)
    t += 100_000
    for _ in range(20):
        for pid, weight in ((1000, 32), (1001, 8), (1002, 8), (1003, 4), (1004, 1)):
            t += 1000
            task(R.ENQUEUE, 0, pid, t, score=weight << 48)
    t += 100_000

    def sync(op, fd, obj, result, tid, ts, waits=0):
        put(T.NTSYNC, pid=1000, tid=tid, op=op, fd=fd, obj=obj, result=result, ts=ts, wait_count=waits, fds=[fd] * waits, objs=[obj] * waits)

    for k, (op, fd, obj) in enumerate(((6, 10, 0xE0000), (R.CREATE_SEM, 11, 0x50000), (R.CREATE_MUTEX, 12, 0xA0000))):
        sync(op, fd, obj, 0, 1001, t + k * 1000)
    for i in range(64):
        sync(R.EVENT_SET, 10, 0xE0000, 0, 1001, t + 10_000 + i * 5000)
        sync(R.EVENT_RESET, 10, 0xE0000, 0, 1001, t + 11_000 + i * 5000)
        if i % 4 == 0:
            sync(R.SEM_RELEASE, 11, 0x50000, 1, 1001, t + 12_000 + i * 5000)
    sync(R.WAIT_ANY, 10, 0xE0000, -999, 1002, t + 500_000, 1)
    for i in range(24):
        sync(R.WAIT_ANY, 11, 0x50000, 0, 1001, t + 520_000 + i * 40_000, 1)
    for i in range(1200):
        sync(R.WAIT_ANY, 12, 0xA0000, 0, 1003, t + 560_000 + i * 5000, 1)
    io = lambda nr, fd, result, count, tid, ts: put(T.IO, pid=1000, tid=tid, nr=nr, fd=fd, result=result, count=count, ts=ts)
    for i in range(12):
        io(202, 0, 0, 0xF00000, 1004, t + 600_000 + i * 30_000)
    io(202, 0, -999, 0xF00000, 1005, t + 980_000)
    t += 600_000
    for i in range(32):
        io(0, 5, 4096, 4096, 1001, t + i * 2000)
        io(1, 6, 256, 256, 1001, t + i * 2000 + 500)
    io(271, 9, -999, 0, 1002, t + 100_000)
    t += 50_000
    heap = lambda op, addr, size, tid, ts: put(T.HEAP, pid=1000, tid=tid, op=op, addr=addr, size=size, ts=ts)
    end = lambda op, nr, tid, ts, code=0: put(T.SIGNAL, pid=1000, tid=tid, op=op, signal=nr, exit_code=code, ts=ts)
    end(0, 11, 1006, t)
    end(1, 11, 1006, t + 1000, 139)
    heap(R.MALLOC, 0xABC000, 4096, 1007, t + 2000)
    heap(R.MALLOC, 0xABD000, 8192, 1007, t + 3000)
    end(0, 6, 1007, t + 4000)
    end(1, 6, 1007, t + 5000, 134)
    put(T.ABORT, pid=1000, tid=1007, line=42, ts=t + 4500, msg="m", loc="l")
    t += 200_000
    for k, (op, addr, size) in enumerate(((R.MALLOC, 0xAAAA00, 128), (R.FREE, 0xAAAA00, 0), (R.MALLOC, 0xBBBB00, 256), (R.FREE, 0xBBBB00, 0), (R.FREE, 0xBBBB00, 0))):
        heap(op, addr, size, 1001, t + k * 1000)
    return b"".join(out)


#: The classes and gauges of that log.
KNOWN = {
    "locality": ("CACHE-LOCAL", {"locality_tier_moves_0": 23, "locality_tier_moves_1": 12, "locality_tier_moves_2": 0, "locality_tier_moves_3": 0, "locality_local_pct": 100, "locality_migration_rate_hz": 296.73338928877246, "locality_intermigration_us_p50": 54, "locality_intermigration_us_p99": 68}),
    "summary": ("EVENTS", {"events_total": 9914, "dispatches_per_sec": 0, "preempts_per_sec": 16956.193673644142, 'events_total{type="6",subtype="wait_any"}': 1224, 'events_total{type="6",subtype="wait_any.enter"}': 1, 'events_total{type="7",subtype="WAKE2RUN"}': 2036, 'events_total{type="7",subtype="CPU_IDLE"}': 286, 'events_total{type="5",subtype="nr=202"}': 13, 'events_total{type="5",subtype="ppoll"}': 1, 'events_total{type="8",subtype="free"}': 3}),
    "sched": ("FAST", {"wake2run_us_p50": 16.7, "wake2run_us_p99": 4000, "wake2run_us_p999": 5000, "wake2run_us_worst": 18000, "wake2run_fast_pct": 98.96856581532417, "wake2run_mid_pct": 0, "wake2run_tickfloor_pct": 1.031434184675835, "wake2run_crossdomain_pct": 32.76031434184676}),
    "work-conservation": ("CONSERVING", {}), "placement-race": ("PLACEMENT-MISS", {"floored_wakes": 21, "placement_miss_pct": 100, "saturated_pct": 0, "avg_idle_at_miss": 3}),
    "dispatch-stall": ("PREEMPT-STARVED", {"dispatch_preempt_pct": 100, "dispatch_order_pct": 0, "dispatch_avg_passovers": 0, "dispatch_passover_p99": 0, "dispatch_concentration_ratio": 0}),
    "kick-latency": ("UNANSWERED", {"kicks_total": 12, "kicks_unanswered": 2, "kicks_tickless_raced": 0, "kick_unanswered_pct": 16.666666666666668, "kick_resched_us_p50": 6}),
    "kstrand": ("STRAND-HELD", {"kstrand_events_total": 3, "kstrand_worst_held_ms": 140}), "slice": ("EVEN", {"slice_us_p50": 201.2, "slice_us_p99": 201.2, "slice_us_worst": 372.4}), "storm": ("NONE", {"storm_captured": 0}),
    "service": ("SKEWED", {"service_top1_pct": 50.025205830915475, "service_pids": 2}), "wakers": ("NO-HOT-WAKERS", {"waker_pids": 1, "waker_hot_pids": 0, "waker_wakes_total": 2000, "waker_hot_threshold": 16000, "waker_messenger_wake2run_us_p99": 0, "waker_worker_wake2run_us_p50": 16.7, "waker_worker_wake2run_us_p99": 4000, "waker_worker_wake2run_us_p999": 5000}),
    "waits": ("CONCENTRATED", {"waits_total": 1237}), "spins": ("LIVELOCK", {"spin_runs_total": 1, "spin_peak_rate_per_s": 200166.80567139282}), "pairing": ("STUCK-SIGNALED", {"pairing_waits": 1224, "pairing_signals": 144, "unsignaled_flag": 1}), "abortpm": ("ABORT", {"aborts_total": 1, "victim_bytes": 8192}),
    "signals": ("TEARDOWN-ONLY", {"signal_exits_total": 2, "signal_delivers_total": 2, "midtrace_signal_deaths_total": 0}), "endstate": ("STALLED", {"endstate_blocked_threads": 1, "endstate_stalled_threads": 1}), "iowait": ("IOWAIT-PARKED", {}), "futex": ("FUTEX-PARKED", {"futex_blocked_threads": 2, "futex_idle_parked": 1, "futex_spinning": 0}),
    "doublefree": ("LOGIC", {"doublefree_total": 1, "doublefree_cross_thread_total": 0, "frees_total": 3}), "fractal": ("UNCORRELATED", {}), "seat": ("SEATED", {"seat_floored_wake_ratio": 0.9896856581532416, "seat_self_preempting": 0}), "matrix-profile": ("DISCORD", {"matrix_profile_discord_score": 2.514803421750856, "matrix_profile_mean": 1.2110706012456653, "matrix_profile_discord_ms": 93.99220312499999}),
    "classmix": ("CLASS-MIX", {"pids": 5}), "iolat": ("NO-IO", {}), "field-persist": ("NO-FIELD-GATE", {}), "keyedevt": ("NO-KEYED-EVENTS", {"keyedevt_wedged_threads": 0}), "heapstk": ("NO-HEAPSTACK", {}),
}


def test_known_log(spark, tmp_path):
    (tmp_path / "a.mtk").write_bytes(known_log())
    T.read_traces(spark, str(tmp_path / "a.mtk")).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    got = {r["report"]: r for r in R.run_reports(e).collect()}
    assert {k: got[k]["class"] for k in KNOWN} == {k: c for k, (c, _) in KNOWN.items()} and len(KNOWN) == 29
    wrong = {(k, g): (got[k]["gauges"].get(g), v) for k, (_, gauges) in KNOWN.items() for g, v in gauges.items() if got[k]["gauges"].get(g) is None or abs(got[k]["gauges"][g] - v) > 1e-9 * max(1, abs(v))}
    assert not wrong
    off = {(r.kind, r.id): (r.value, r.sev) for r in R.offenders(e).collect()}
    assert off["spin", "tid=1003"][1] == 2 and off["unsignaled", "fd=12"] == (1200, 2) and off["double-free", f"addr={0xBBBB00}"][0] == 256 and off["kthread-strand", "tid=802"] == (140, 2)
    lines = [r.line for r in R.to_prometheus(R.run_reports(e, ["summary", "storm"])).collect()]
    assert 'weir_events_total{type="7",subtype="WAKE2RUN",report="summary"} 2036.0' in lines and "# TYPE weir_events_total gauge" in lines
    assert R.to_text(R.run_reports(e, ["storm"])).first().line == "VERDICT: storm is NONE: storm_captured 0.000"


def test_known_log_without_idle_stream(spark, tmp_path):
    (tmp_path / "a.mtk").write_bytes(known_log(idle=False))
    assert R.REPORTS["placement-race"](T.read_traces(spark, str(tmp_path / "a.mtk"))).first()["class"] == "NO-IDLE-STREAM"


def made(spark, *rows):
    fields = [dict(zip(("type", "op", "ts", "pid", "tid", "cpu"), r[:6])) | r[6] for r in rows]
    return spark.createDataFrame([tuple(({"seq": i, "file": "f"} | f).get(c) for c in T.COLUMNS) for i, f in enumerate(fields)], T.SCHEMA)


def test_classes_that_depend_on_one_rule(spark):
    cls = lambda name, *rows: R.REPORTS[name](made(spark, *rows)).first()["class"]
    s = lambda op, ts=0, pid=1, cpu=0, **f: (T.SCHED, op, ts, pid, None, cpu, f)
    assert cls("seat", *[s(R.SWITCH_IN)] * 20, *[s(R.WAKE2RUN, runtime=5)] * 8) == "SELF-PREEMPTING"
    topo = (T.PROVIDER, None, 0, None, None, None, {"name": "cache_topology", "payload": "\n".join(f'x{{cpu="{c}",l2="{c // 2}",l3="{c // 4}",socket="{c // 8}"}} 1' for c in range(16))})
    move = lambda a, b: s(R.WAKE2RUN, cpu=b, last_cpu=a, runtime=5)
    assert cls("locality", topo, *[move(0, 1)] * 5, *[move(0, 2)] * 10) == "SCATTERED" and cls("locality", topo, *[move(0, 1)] * 10, *[move(0, 2)] * 5) == "CACHE-LOCAL"
    assert cls("dispatch-stall", s(R.WAKEUP)) == "NO-FLOORED"
    strand = lambda ts: (T.KSTRAND, None, ts, None, 9, 0, {"runtime": 60 * MS})
    idle = (s(R.CPU_IDLE, 1000 * MS, sub=1), s(R.CPU_IDLE, 1100 * MS, sub=0))
    assert cls("kstrand", *idle, strand(1090 * MS), strand(500 * MS), strand(600 * MS)) == "STRAND-HELD" and cls("kstrand", *idle, strand(1090 * MS), strand(500 * MS)) == "STRAND-DARK"
    fx = lambda cmd, ts, tid, addr: (T.IO, None, ts, 1, tid, None, {"nr": 202, "fd": cmd, "count": addr, "result": 0})
    spin = [fx(6, i * MS, 5, 64) for i in range(60)]
    assert cls("futex", *spin) == "FUTEX-SPIN" and cls("futex", *spin, fx(0, 60 * MS, 6, 128), fx(0, 60 * MS, 7, 128)) == "FUTEX-PARKED"
    assert cls("futex", *spin[:30], fx(6, 29 * MS, 5, 99), *spin[30:50]) == "FUTEX-PARKED"  # tries on one address in a row
    wait = lambda ts, tid: (T.NTSYNC, R.WAIT_ANY, ts, 1, tid, None, {"result": -999, "fd": 1, "wait_count": 1, "objs": [5], "fds": [1]})
    act = lambda ts, tid: (T.HEAP, R.MALLOC, ts, 1, tid, None, {"addr": 4096, "size": 1})
    dead = lambda ts, tid: (T.SIGNAL, 1, ts, 1, tid, None, {"signal": 9})
    assert cls("endstate", wait(0, 1), act(5 * MS, 1)) == "LOST-COMPLETION" and cls("endstate", wait(0, 1), act(5 * MS, 1), wait(0, 2)) == "STALLED"
    assert cls("endstate", wait(0, 1), dead(5 * MS, 1)) == "NO-PARKED" and cls("endstate", wait(0, 1), dead(5 * MS, 1), act(3000 * MS, 2)) == "STALLED"
    pick = lambda op, ts, pid, cpu: s(op, ts * MS, pid, cpu)
    assert cls("work-conservation", *[pick(R.SWITCH_IN, t, 1, 0) for t in (0, 100, 200)]) == "CONSERVING"  # not a PICK
    assert cls("work-conservation", *[pick(R.PICK, t, 1, 0) for t in (0, 100, 200)]) == "LOCAL-REWAKE-GAP"
    assert cls("work-conservation", pick(R.PICK, 0, 1, 0), pick(R.PICK, 1, 2, 1), pick(R.PICK, 100, 2, 0), pick(R.PICK, 101, 3, 1)) == "MIXED-CLOSE"
    assert cls("work-conservation", pick(R.PICK, 0, 1, 0), pick(R.PICK, 1, 2, 1), pick(R.PICK, 100, 2, 0)) == "PULL-CLOSED"
    hit = lambda reenq, preempt, ms=100: (T.STORM, None, 0, None, None, None, {"interval_ms": ms, "kicks": 50, "preempt_kicks": preempt, "reenq": reenq})
    assert cls("storm", hit(9000, 4500), hit(100, 0)) == "IDLE-REENQUEUE-CHURN" and cls("storm", hit(9000, 4000), hit(100, 600)) == "REAL-IPI-STORM"
    g = R.REPORTS["storm"](made(spark, hit(9000, 4500), hit(100, 0, 300))).first()["gauges"]
    assert g["storm_captured"] == 1 and g["storm_kick_per_s"] == 250 and g["storm_reenq_per_s_peak"] == 90000


def spin_log(spark, *runs, extra=()):
    """Runs (tid, object, waits, microseconds between them, results dealt in turn), each a second after the one before."""
    rows, t = [], 0
    for tid, fd, n, step, results in runs:
        t += 1000 * MS
        for i in range(n):
            rows.append((T.NTSYNC, R.WAIT_ANY, t + i * step * 1000, 1, tid, None, {"fd": fd, "result": results[i % len(results)]}))
    return made(spark, *rows, *extra)


def test_spins_count_runs_by_class(spark):
    cls = lambda *runs: R.REPORTS["spins"](spin_log(spark, *runs)).first()
    late = (5, 7, 1000, 50, [-110])
    assert cls((5, 7, 3000, 50, [0]), late, late, late)["class"] == "STARVED-WAITER"  # three runs against one that is longer
    assert cls((5, 7, 1000, 50, [0, 0, 0, 0, -110, -110, -110, -4, -4, -4]))["class"] == "LIVELOCK"  # 40, 30 and 30 percent
    assert cls(late, (5, 7, 1000, 50, [-4]))["class"] == "ERROR-SPIN" and cls(late, (5, 7, 1000, 50, [0]))["class"] == "LIVELOCK"
    assert cls((5, 7, 1000, 50, [0, -110]))["class"] == "LIVELOCK" and cls((5, 7, 1000, 50, [-110, -4]))["class"] == "STARVED-WAITER"
    got = cls((5, 7, 2000, 0, [0]))  # waits of one time stamp are no run
    assert got["class"] == "NONE" and got["gauges"]["spin_runs_total"] == 0
    assert cls((5, 7, 999, 50, [0]))["class"] == "NONE" and cls((5, 7, 1500, 1000, [0]))["class"] == "NONE"


def test_spin_offenders_are_without_a_partner(spark):
    signal = lambda fd, n, op=R.EVENT_SET: [(T.NTSYNC, op, 5 * MS, 1, 99, None, {"fd": fd})] * n
    off = lambda *runs, extra=(): {(r.id, r.obj): r.sev for r in R.offenders(spin_log(spark, *runs, extra=extra)).where("kind = 'spin'").collect()}
    fast, slow = (5, 7, 1000, 50, [0]), (6, 8, 1000, 200, [0])
    assert off(fast, slow) == {("tid=5", "obj=7"): 2, ("tid=6", "obj=8"): 1}  # 20,000 a second, and 5,000
    assert off(fast, slow, extra=signal(7, 10)) == {("tid=6", "obj=8"): 1} and off(fast, extra=signal(7, 9)) == {("tid=5", "obj=7"): 2}
    assert off(fast, extra=signal(7, 10, R.EVENT_PULSE)) == {("tid=5", "obj=7"): 2}
    assert off((5, 7, 1000, 200, [-110]), extra=signal(7, 1000)) == {("tid=5", "obj=7"): 2}  # waits that fail are blamed with a partner too
    strands = made(spark, *[(T.SCHED, R.PICK, t * 100 * MS, 1, None, 0, {}) for t in range(12)])
    assert [(r.value, r.sev) for r in R.offenders(strands).where("kind = 'idle-strand'").collect()] == [(11.0, 2)]


def test_scaling_of_the_known_log(spark, tmp_path):
    (tmp_path / "a.mtk").write_bytes(known_log())
    r = R.REPORTS["fractal"](T.read_traces(spark, str(tmp_path / "a.mtk"))).first()
    g = r["gauges"]
    got = {k: round(g[f'fractal_{k}{{series="dispatch-rate"}}'], 4) for k in ("hurst_dfa", "hurst_dfa_se", "hurst_rs", "dimension", "decades")}
    assert r["class"] == "UNCORRELATED" and got == {"hurst_dfa": 0.5897, "hurst_dfa_se": 0.0993, "hurst_rs": 0.2327, "dimension": 1.4103, "decades": 2.8675}
    assert round(g['fractal_hurst_dfa{series="migration-rate"}'], 4) == 0.4961


def test_bursts_and_scales_across_chunks(spark, monkeypatch):
    import math

    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(R.fractal, "CHUNK", 8)
    r = np.random.default_rng(6)
    bins = np.repeat(np.arange(400), r.poisson(np.where(np.arange(400) // 25 % 2, 3.0, 0.7)))
    ts = [int(x) for x in bins * 10_000 + 5] + [0, 3_999_999]
    v = np.bincount([t // 10_000 for t in ts], minlength=400)
    line = R.fractal.timeline(spark.createDataFrame([(t,) for t in ts], "ts long"), all_=F.lit(True), none=F.lit(False))
    assert {(x.bin, x.v, x.upto) for x in line.where("series = 'all-'").collect()} == set(zip(range(400), v.tolist(), np.cumsum(v).tolist())) and line.where("series = 'none' and upto = 0").count() == 400
    want, run, cut = [], 0, np.median(v[v > 0])
    for i, x in enumerate([*v, 0]):
        if x > cut:
            run += int(x)
        elif run:
            want.append((i - 1, run))
            run = 0
    assert sorted((x.burst, x["size"]) for x in R.fractal.bursts(line).collect()) == want and max(s for _, s in want) > 20
    size = np.sort([s for _, s in want])
    got = R.fractal.tail(R.fractal.bursts(line)).first()
    assert got.avalanches == len(want) and abs(got.slope - np.polyfit(np.log(size), np.log((len(size) - np.arange(len(size))) / len(size)), 1)[0]) < 1e-9
    y = np.cumsum(v - v.mean())
    xs, fs = [], []
    for s in sorted({int(math.floor(10 ** (math.log10(4) + (math.log10(100) - math.log10(4)) * j / 13))) for j in range(14)} - {3}):
        seg = y[: 400 // s * s].reshape(-1, s)
        fit = np.array([g - np.polyval(np.polyfit(np.arange(s), g, 1), np.arange(s)) for g in seg])
        xs.append(math.log(s)), fs.append(math.log(math.sqrt((fit**2).mean(axis=1).mean())))
    d = R.fractal.dfa(line).where("series = 'all-'").first()
    assert abs(d.slope - np.polyfit(xs, fs, 1)[0]) < 1e-6
    assert R.fractal.timeline(spark.createDataFrame([(5,), (5,)], "ts long"), a=F.lit(True)).count() == 0


def test_aborts_name_the_topmost_live_chunk(spark):
    heap = lambda op, tid, addr, size=0, new=0: (T.HEAP, op, 0, 1, tid, None, {"addr": addr, "size": size, "new_addr": new})
    abort = lambda tid: (T.ABORT, None, 0, 1, tid, None, {})
    far = 1 << 26
    e = made(spark, abort(9), heap(R.MALLOC, 5, 0x1000, 16), heap(R.MALLOC, 6, 0x3000, 48), heap(R.MALLOC, 6, 0x2000, 32), abort(5), heap(R.FREE, 6, 0x3000), abort(5),
        heap(R.MALLOC, 5, far + 64, 7), abort(5), heap(R.FREE, 5, far + 64), abort(5), heap(R.REALLOC, 6, 0x2000, 99, 0x5000), heap(R.MALLOC, 5, 0), heap(R.CALLOC, 5, 0x4000, 8), abort(5), heap(R.MALLOC, 7, 0x5000, 1), abort(5))
    got = {r["at"]: (r.arena, r.live, r.victim, r.victim_bytes) for r in R.abort_victims(e).collect()}
    # By row: no allocation; the highest of three; it was freed; another arena; nothing left of the last allocation's arena; a moved chunk; its address taken by another.
    assert got == {0: (None, 0, None, None), 4: (0, 3, 0x3000, 48), 6: (0, 2, 0x2000, 32), 8: (1, 1, far + 64, 7), 10: (1, 0, None, None), 14: (0, 3, 0x5000, 99), 16: (0, 3, 0x5000, 1)}
    top = R.abort_victims(e).where("at = 4").first().top
    assert [(t["rank"], t.a, t["size"], t.by) for t in top] == [(1, 0x3000, 48, 6), (2, 0x2000, 32, 6), (3, 0x1000, 16, 5)]
    off = [(r.id, r.obj, r.value) for r in R.offenders(e).where("kind = 'abort'").orderBy("obj", "value").collect()]
    assert ("tid=9", "unattributed", 0.0) in off and ("tid=5", f"addr={0x5000}", 99.0) in off and len(off) == 7
    assert R.abort_victims(e.limit(0)).count() == 0


def test_rings_hold_the_last_records_of_a_thread(spark):
    heap = lambda tid, i: (T.HEAP, R.MALLOC, i, 1, tid, None, {"addr": 16 * i, "size": i})
    wait = lambda tid, result: (T.NTSYNC, R.WAIT_ANY, 0, 1, tid, None, {"fd": 3, "result": result, "wait_count": 2})
    e = made(spark, *[heap(5, i) for i in range(1, 21)], heap(6, 99), wait(5, -999), wait(5, 0), (T.MMAP, None, 7, 1, 5, None, {"addr": 4096, "size": 8, "fd": 4}), (T.ABORT, None, 0, 1, 5, None, {}), heap(5, 50), (T.ABORT, None, 0, 1, 5, None, {}), (T.ABORT, None, 0, 1, 8, None, {}))
    got = {}
    for r in R.abort_rings(e).orderBy("at", "back").collect():
        got.setdefault(r["at"], []).append((r.kind, r.a, r.b))
    first = [("map", 4096, 8), ("wait", 0, 2)] + [("heap", 16 * i, i) for i in range(20, 12, -1)]
    assert list(got.values()) == [first[:8], [("heap", 800, 50), *first[:7]]]


def test_dispatch_stall_in_detail(spark):
    s = lambda op, ts, pid=1, cpu=0, **f: (T.SCHED, op, ts * MS, pid, None, cpu, f)
    score = lambda cls, age: (cls << 48) + age
    gauges = lambda *rows: (lambda r: (r["class"], {k.removeprefix("dispatch_"): v for k, v in r["gauges"].items() if v is not None}))(R.REPORTS["dispatch-stall"](made(spark, *rows)).first())
    # Task 9 waits from 10 to 20 on CPU 0 and is picked at 20.5 with class 4, age 50; five picks of three tasks pass it over.
    passed = [s(R.PICK, 11, 2, score=score(8, 1), sub=0), s(R.PICK, 12, 3, score=score(4, 60), sub=1), s(R.PICK, 13, 3, score=score(4, 40), sub=0), s(R.PICK, 14, 4, score=score(2, 99), sub=0), s(R.PICK, 15, 9, score=0), s(R.PICK, 16, 2, cpu=1, score=0)]
    wake = [s(R.WAKE2RUN, 20, 9, runtime=10 * MS), (T.SCHED, R.PICK, 20_500_000, 9, None, 0, {"score": score(4, 50), "sub": 1})]
    cls, g = gauges(*passed, *wake)
    assert cls == "ORDER-STARVED" and g["avg_passovers"] == 4 and g["passover_mirror_pct"] == 75 and g["served_mirror_pct"] == 0
    assert (g["passover_higher_class_pct"], g["passover_same_class_pct"], g["passover_lower_class_pct"]) == (25, 50, 25)
    assert g["passover_p99"] == 4 and g["ceiling_remains_pct"] == 50 and g["concentration_ratio"] == 0.75 and "dark_pct" not in g
    assert gauges(*passed, wake[0])[1]["ceiling_remains_pct"] == 100  # never served: all count as legitimate
    # A second wake that nothing passed over halves the tasks a wake, not the picks a wake that was passed over.
    cls, g = gauges(*passed, *wake, s(R.WAKE2RUN, 40, 9, cpu=3, runtime=5 * MS))
    assert cls == "PREEMPT-STARVED" and g["avg_passovers"] == 4 and g["concentration_ratio"] == 0.375 and g["preempt_pct"] == g["order_pct"] == 50
    idle = [s(R.CPU_IDLE, 0, cpu=5, sub=1), s(R.CPU_IDLE, 5, cpu=5, sub=0), s(R.CPU_IDLE, 100, cpu=6, sub=1), s(R.CPU_IDLE, 130, cpu=7, sub=1)]
    cls, g = gauges(*idle, s(R.WAKE2RUN, 10, 9, cpu=5, runtime=10 * MS), s(R.WAKE2RUN, 11, 9, cpu=5, runtime=8 * MS), s(R.WAKE2RUN, 160, 9, cpu=8, runtime=4 * MS))
    assert cls == "PREEMPT-STARVED" and round(g["dark_pct"]) == 33 and round(g["held_pct"]) == 67 and g["worst_dark_ms"] == 10 and "passover_mirror_pct" not in g
    assert g["censored_strands"] == 1 and g["worst_censored_ms"] == 60  # CPU 6; CPU 7 has been idle for 30
    cls, g = gauges(s(R.CPU_IDLE, 100, cpu=6, sub=1), s(R.WAKEUP, 200))
    assert cls == "NO-FLOORED" and g == {"stalled": 0, "censored_strands": 1, "worst_censored_ms": 100}


def frame(spark, *rows):
    """Records with the given fields, seq in their order."""
    columns = list(T.COLUMNS)
    return spark.createDataFrame([tuple({"file": "x", "seq": i, **r}.get(c) for c in columns) for i, r in enumerate(rows)], T.SCHEMA)


def test_cold_wakes(spark):
    """An exit before the wake, and a short idle time, make no cold wake; a WAKEUP record is none."""
    idle = lambda cpu, sub, ts: {"type": T.SCHED, "op": R.CPU_IDLE, "cpu": cpu, "sub": sub, "ts": ts}
    run = lambda cpu, ts, runtime, freq=0: {"type": T.SCHED, "op": R.WAKE2RUN, "cpu": cpu, "sub": 0, "ts": ts, "runtime": runtime, "freq": freq}
    rows = [idle(0, 1, 0), run(0, 25 * MS, 5, 900), idle(0, 0, 26 * MS), run(0, 90 * MS, 6, 900), idle(1, 1, 0), run(1, 10 * MS, 7, 900), {"type": T.SCHED, "op": R.WAKEUP, "cpu": 1, "ts": 50 * MS}]
    rows += [idle(2, 1, 0), *(run(2, 30 * MS + i, 10 + i // 2, f) for i, f in enumerate((0, 800, 800, 2000, 3000, 0, 2500, 1000)))]
    e = frame(spark, *rows)
    cold = R.cold_wakes(e)
    assert sorted((r.cpu, r.runtime) for r in cold.collect()) == [(0, 5)] + [(2, 10 + i // 2) for i in range(8)]
    assert sorted((r.runtime, r.freq) for r in R.slowest_quarter(cold).collect()) == [(13, 1000), (13, 2500)]
    assert [r.freq for r in R.slowest_quarter(cold.where("cpu = 2 and runtime < 12 or cpu = 0")).collect()] == [2000]  # one of two that tie: the later
    g = R.REPORTS["sched"](e).first().gauges
    assert g["coldwake_count"] == 9 and g["coldwake_freq_min_mhz"] == 800 and g["coldwake_freq_slowq_mhz"] == 2500 and g["coldwake_wake2run_us_worst"] == 0.013
    assert R.REPORTS["sched"](e.where("cpu = 1")).first().gauges["coldwake_count"] is None and R.slowest_quarter(cold.limit(0)).count() == 0


def test_inversions(spark):
    """As classify has them, for ascending, descending, rotated, tied and random lists of 3 to 8 values."""
    import random

    from weir.functions.disorder import classify

    dice = random.Random(3)
    lists = [[dice.randrange(k) for _ in range(n)] for n in range(3, 9) for k in (2, 4, 50) for _ in range(12)] + [list(range(n)) for n in range(3, 9)] + [list(range(n))[::-1] for n in range(3, 9)] + [[3, 4, 1, 2, 3], [1, 1, 1], [2, 3, 1]]
    df = spark.createDataFrame([([float(x) for x in v],) for v in lists], "v array<double>")
    from pyspark.sql import functions as F

    for v, got in df.select("v", R.inversions(F.col("v"), 8)).collect():
        assert got == classify(v)["inversion"], v
    assert spark.createDataFrame([([1.0, 2.0],), ([],)], "v array<double>").select(R.inversions(F.col("v"), 8).alias("x")).where("x is not null").count() == 0


def test_details(spark, events):
    from weir.operators import details as DT

    rows = {(r.report, r.gauge, r.labels): r.value for r in DT.details(events).collect()}
    busy = 'tid="50",obj="0x000000000000000c"'
    assert rows["waits", "waits_total", busy] == 1100 and rows["waits", "wait_gap_ms", busy + ',quantile="0.99"'] == 0.005
    assert rows["spins", "spin_runs_total", busy + ',verdict="LIVELOCK"'] == 1 and rows["pairing", "unsignaled_flag", 'fd="12"'] == 1 and rows["pairing", "pairing_signals", 'fd="10"'] == 1
    assert rows["kstrand", "kstrand_ms", 'comm="",cpu="1",quantile="worst"'] == 60 or any(k[1] == "kstrand_ms" and v == 60 for k, v in rows.items())
    assert rows["sched", "wake2run_structured_pct", ""] == 0
    assert all(r.result == 0 and r.n == 1100 for r in DT.wait_results(events).where("tid = 50").collect())
    line = f'weir_waits_total{{{busy},report="waits"}} 1100.0'
    assert line in [r.line for r in DT.to_prometheus(DT.details(events, ["waits"])).collect()]
    assert DT.details(events.limit(0)).count() == 0


def test_structured_share(spark):
    """Half of the wakes ascend, half are scattered: the windows' classes are those of classify."""
    from weir.functions.disorder import classify
    from weir.operators import details as DT

    lat = [i * 3 for i in range(2000)] + [(i * 7919) % 100_003 for i in range(2000)]
    e = frame(spark, *({"type": T.SCHED, "op": R.WAKE2RUN, "cpu": i % 3, "sub": 0, "ts": i, "runtime": v} for i, v in enumerate(lat)))
    wins = [classify(lat[a : a + 500])["cls"] for a in range(0, 4000, 500)]
    got = DT.details(e, ["sched"]).first().value
    assert got == 100.0 * sum(c != "RANDOM" for c in wins) / len(wins) and 0 < got < 100
