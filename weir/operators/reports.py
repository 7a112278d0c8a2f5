"""Diagnostic reports over an event table: each gives one typed row (report, class, gauges).

A report is a function of the events that ends in a frame of one row; names of its gauges are keys of a map.
Empty input gives a named class. Order is that of seq.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.functions.disorder import sampled_pairs
from weir.operators import fractal
from weir.operators.stream import ranked_by
from weir.operators.temporal import asof
from weir.sources.trace import ABORT, DROPS, HEAP, HEAPSTACK, IO, KEYED, KSTRAND, MMAP, NTSYNC, PROVIDER, SCHED, SIGNAL, STORM

#: Operation codes and thresholds.
ENQUEUE, PICK, PREEMPT_TICK, WAKEUP, WAKE2RUN, CPU_IDLE, SWITCH_IN, FIELD_GATE, KICK, RESCHED, TICK_STOP = 1, 2, 4, 6, 7, 8, 9, 10, 11, 12, 13
CREATE_SEM, SEM_RELEASE, WAIT_ANY, WAIT_ALL, CREATE_MUTEX, MUTEX_UNLOCK, CREATE_EVENT, EVENT_SET, EVENT_RESET, EVENT_PULSE = 0, 1, 2, 3, 4, 5, 7, 8, 9, 10
FUTEX, ENTRY, BLOCKING = 202, -999, (7, 271, 232, 281, 47, 45, 23, 270, 16)
FLOOR, FAST, SLICE_MOST, STRAND, SPIN_GAP, SPIN_ITERS = 900_000, 100_000, 10_000_000, 50_000_000, 1_000_000, 1000
TIMED_OUT, WAITS_A_SIGNAL = -110, 100
MALLOC, FREE, REALLOC, CALLOC = 0, 1, 2, 3
FUTEX_WAITS, FUTEX_WAKES = (0, 6, 9, 11), (1, 7, 10)
#: Time that a parked thread may act after its wait, time that an ended thread must have been parked, and reenqueues a second of a storm.
PARKED, KILLED, STORM_RATE = 1_000_000, 2_000_000_000, 50_000

Report = Callable[[DataFrame], DataFrame]
REPORTS: dict[str, Report] = {}


def report(name: str) -> Callable[[Report], Report]:
    """Register a report: a column `labelled` holds gauges that carry labels, the others are gauges of their own name."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Report:
        def run(events: DataFrame) -> DataFrame:
            out = f(events)
            gauges = [c for c in out.columns if c not in ("class", "labelled")]
            pairs = [x for c in gauges for x in (F.lit(c), F.col(c).cast("double"))]
            own = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
            return out.select(F.lit(name).alias("report"), "class", (F.map_concat(own, "labelled") if "labelled" in out.columns else own).alias("gauges"))

        REPORTS[name] = run
        return run

    return add


def _cls(*cases: tuple[Column, str], other: str) -> Column:
    out = None
    for when, name in cases:
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise(other).alias("class")


def sched(e: DataFrame, *ops: int) -> DataFrame:
    return e.where((F.col("type") == SCHED) & F.col("op").isin(*ops))


def picks(e: DataFrame) -> DataFrame:
    """The dispatch stream: PICK, or SWITCH_IN where no PICK was captured."""
    has = sched(e, PICK).agg((F.count("*") > 0).alias("has_pick"))
    return sched(e, PICK, SWITCH_IN).join(F.broadcast(has)).where(F.col("op") == F.when(F.col("has_pick"), PICK).otherwise(SWITCH_IN)).drop("has_pick")


def _ranked(values: DataFrame, column: str) -> DataFrame:
    """(v, k, upto, n): how often each value occurs, how many values there are up to it and in all.

    Ranks come from totals of at most a few thousand logarithmic buckets, which ascend with the value, and a window
    inside each bucket.
    """
    c = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    c = c.withColumn("b", F.floor(F.signum("v") * F.log2(F.abs("v") + 1) * 64))
    buckets = c.groupBy("b").agg(F.sum("k").alias("kb"))
    below = buckets.select("b", (F.sum("kb").over(Window.orderBy("b")) - F.col("kb")).alias("below"), F.sum("kb").over(Window.partitionBy(F.lit(1))).alias("n"))
    return c.join(F.broadcast(below), "b").select("v", "k", (F.col("below") + F.sum("k").over(Window.partitionBy("b").orderBy("v"))).alias("upto"), "n")


def q_at(values: DataFrame, column: str, qs: dict[str, float]) -> DataFrame:
    """One row: quantiles by floor index, the number n and the greatest value (worst). Equal values are counted together."""
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    return _ranked(values, column).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("v").alias("worst"), *(F.min(F.when(F.col("upto") > at(q), F.col("v"))).alias(name) for name, q in qs.items()))


def waits_of(e: DataFrame) -> DataFrame:
    """Waits (tid, obj, result, ts, seq) of either kind: those on objects when they end, those on futexes as traced."""
    nt = e.where((F.col("type") == NTSYNC) & F.col("op").isin(WAIT_ANY, WAIT_ALL) & (F.col("result") != ENTRY)).select("tid", "fd", F.coalesce("fd", F.lit(-1)).cast("long").alias("obj"), "result", "ts", "seq")
    fx = e.where((F.col("type") == IO) & (F.col("nr") == FUTEX) & (F.col("fd").bitwiseAND(127).isin(*FUTEX_WAITS))).select("tid", "fd", F.col("count").alias("obj"), "result", "ts", "seq")
    return nt.union(fx)


def signals_of(e: DataFrame) -> DataFrame:
    """Signals (obj, ts, seq) of either kind: operations that change an object, and wakes of futexes."""
    nt = e.where((F.col("type") == NTSYNC) & F.col("op").isin(EVENT_SET, EVENT_RESET, SEM_RELEASE, MUTEX_UNLOCK)).select(F.coalesce("fd", F.lit(-1)).cast("long").alias("obj"), "ts", "seq")
    fx = e.where((F.col("type") == IO) & (F.col("nr") == FUTEX) & F.col("fd").bitwiseAND(127).isin(*FUTEX_WAKES)).select(F.col("count").alias("obj"), "ts", "seq")
    return nt.union(fx)


#: Names of operations by record type.
SUBTYPES = {
    SCHED: {1: "ENQUEUE", 2: "PICK", 3: "PICK_EMPTY", 4: "PREEMPT_TICK", 5: "PREEMPT_WAKEUP", 6: "WAKEUP", 7: "WAKE2RUN", 8: "CPU_IDLE", 9: "SWITCH_IN", 10: "FIELD_GATE", 11: "KICK_ISSUE", 12: "RESCHED", 13: "TICK_STOP"},
    NTSYNC: {0: "create_sem", 1: "sem_release", 2: "wait_any", 3: "wait_all", 4: "create_mutex", 5: "mutex_unlock", 6: "mutex_kill", 7: "create_event", 8: "event_set", 9: "event_reset", 10: "event_pulse", 11: "sem_read", 12: "mutex_read", 13: "event_read"},
    HEAP: {0: "malloc", 1: "free", 2: "realloc", 3: "calloc"},
    SIGNAL: {0: "deliver", 1: "exit_abnormal"},
    IO: {0: "read", 1: "write", 5: "fstat", 7: "poll", 8: "lseek", 16: "ioctl", 17: "pread64", 18: "pwrite64", 23: "select", 45: "recvfrom", 47: "recvmsg", 208: "io_getevents", 209: "io_submit", 232: "epoll_wait", 257: "openat", 270: "pselect6", 271: "ppoll", 281: "epoll_pwait"},
}


def typed_counts(e: DataFrame) -> DataFrame:
    """(type, subtype, n): records by type and operation; waits that only begin are counted apart."""
    op = F.when(F.col("type") == IO, F.col("nr")).otherwise(F.col("op"))
    sub = F.concat(F.lit("op="), op.cast("string"))
    for kind, names in SUBTYPES.items():
        name = F.coalesce(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))[op], F.concat(F.lit("nr=" if kind == IO else "op="), op.cast("string")))
        sub = F.when(F.col("type") == kind, name).otherwise(sub)
    sub = F.when((F.col("type") == NTSYNC) & F.col("op").isin(WAIT_ANY, WAIT_ALL) & (F.col("result") == ENTRY), F.concat(sub, F.lit(".enter"))).otherwise(sub)
    sub = F.when(F.col("type") == PROVIDER, F.col("name")).when(F.col("type") == KSTRAND, "pcpu_kthread").when(F.col("type") == ABORT, "abort").otherwise(sub)
    return e.groupBy("type", F.coalesce(sub, F.lit("")).alias("subtype")).agg(F.count("*").alias("n"))


@report("summary")
def summary(e):
    span = F.greatest((F.max(F.when(F.col("ts") > 0, F.col("ts"))) - F.min(F.when(F.col("ts") > 0, F.col("ts")))) / 1e9, F.lit(0.0))
    s = F.col("type") == SCHED
    a = e.agg(F.count("*").alias("events_total"), span.alias("span_s"), (F.count_if(s & (F.col("op") == PICK)) / F.nullif(span, F.lit(0.0))).alias("dispatches_per_sec"), (F.count_if(s & (F.col("op") == PREEMPT_TICK)) / F.nullif(span, F.lit(0.0))).alias("preempts_per_sec"))
    key = F.format_string('events_total{type="%d",subtype="%s"}', "type", "subtype")
    by = typed_counts(e).agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct(key, F.col("n").cast("double")))), F.create_map().cast("map<string,double>")).alias("labelled"))
    return a.join(by).select("*", _cls((F.col("events_total") == 0, "EMPTY"), other="EVENTS"))


def type_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("type", "op").agg(F.count("*").alias("n"))


@report("waits")
def waits(e):
    w = waits_of(e)
    gap = w.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("tid", "obj").orderBy("seq"))).where("gap > 0")
    top = w.groupBy("tid", "obj").agg(F.count("*").alias("c")).agg(F.max("c").alias("top"), F.coalesce(F.sum("c"), F.lit(0)).alias("waits_total"))
    q = q_at(gap, "gap", {"p50": 0.5, "p99": 0.99})
    return top.join(q).select("waits_total", (F.col("p50") / 1e6).alias("wait_gap_ms_p50"), (F.col("p99") / 1e6).alias("wait_gap_ms_p99"), _cls((F.col("waits_total") == 0, "NO-WAITS"), (F.col("top") * 2 >= F.col("waits_total"), "CONCENTRATED"), other="SPREAD"))


def spin_runs(e: DataFrame) -> DataFrame:
    """(tid, obj, n, rate, verdict) of runs of SPIN_ITERS completed waits or more on one object, each later than the last by less than SPIN_GAP.

    rate is waits a second, 0 for a run without extent. A run is told by the result that most of its waits had: success, then timeouts, wins a tie.
    """
    w = Window.partitionBy("tid", "obj").orderBy("seq")
    gap = F.col("ts") - F.lag("ts").over(w)
    runs = waits_of(e).withColumn("new", F.coalesce(((gap <= 0) | (gap >= SPIN_GAP)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w))
    each = runs.groupBy("tid", "obj", "run").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("span"), F.count_if(F.col("result") >= 0).alias("won"), F.count_if(F.col("result") == TIMED_OUT).alias("late")).where(F.col("n") >= SPIN_ITERS)
    other = F.col("n") - F.col("won") - F.col("late")
    kind = F.when((F.col("won") >= F.col("late")) & (F.col("won") >= other), "LIVELOCK").when(F.col("late") >= other, "STARVED-WAITER").otherwise("ERROR-SPIN")
    return each.select("tid", "obj", "n", F.when(F.col("span") > 0, F.col("n") * 1e9 / F.col("span")).otherwise(0.0).alias("rate"), kind.alias("verdict"))


@report("spins")
def spins(e):
    """The class is that of most runs; of classes with as many runs errors come first, then successes."""
    by = spin_runs(e).groupBy("verdict").agg(F.count("*").alias("runs"), F.max("rate").alias("peak"))
    most = F.struct("runs", F.when(F.col("verdict") == "ERROR-SPIN", 2).when(F.col("verdict") == "LIVELOCK", 1).otherwise(0))
    a = by.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("spin_runs_total"), F.max("peak").alias("spin_peak_rate_per_s"), F.max_by("verdict", most).alias("c"))
    return a.select("spin_runs_total", "spin_peak_rate_per_s", F.coalesce("c", F.lit("NONE")).alias("class"))


def spin_offenders(e: DataFrame) -> DataFrame:
    """(tid, obj, rate, sev): of each thread and object the fastest run, but where the object is signalled (once in 100 waits at least) and most waits succeed: that is a partner at work."""
    peak = spin_runs(e).groupBy("tid", "obj").agg(F.max_by(F.struct("rate", "verdict"), F.struct("rate", "n", "verdict")).alias("p")).select("tid", "obj", "p.*")
    waits_ = waits_of(e).groupBy("obj").agg(F.count("*").alias("waits"))
    sigs = signals_of(e).groupBy("obj").agg(F.count("*").alias("signals"))
    known = peak.join(waits_, "obj").join(sigs, "obj", "left").na.fill(0, ["signals"])
    failing = F.col("verdict") != "LIVELOCK"
    partner = (F.col("signals") > 0) & (F.col("waits") <= F.col("signals") * WAITS_A_SIGNAL)
    return known.where(failing | ~partner).select("tid", "obj", "rate", F.when(failing | (F.col("rate") >= 10_000), 2).otherwise(1).alias("sev"))


def paired(e: DataFrame) -> DataFrame:
    """(fd, waits, signals): completed waits for each object, by its descriptor, and its signals."""
    nt = e.where(F.col("type") == NTSYNC)
    # Entries announce a wait; completions are counted.
    wait = nt.where(F.col("op").isin(WAIT_ANY, WAIT_ALL) & (F.col("result") != ENTRY)).select(F.explode(F.expr("slice(fds, 1, least(greatest(wait_count, 0), 8))")).alias("fd")).groupBy("fd").agg(F.count("*").alias("waits"))
    sig = nt.where(F.col("op").isin(EVENT_SET, EVENT_RESET, SEM_RELEASE, MUTEX_UNLOCK)).groupBy(F.col("fd").cast("long").alias("fd")).agg(F.count("*").alias("signals"))
    return wait.join(sig, "fd", "full").na.fill(0, ["waits", "signals"])


@report("pairing")
def pairing(e):
    a = paired(e).agg(F.coalesce(F.sum("waits"), F.lit(0)).alias("pairing_waits"), F.coalesce(F.sum("signals"), F.lit(0)).alias("pairing_signals"), F.count_if((F.col("waits") >= 1000) & (F.col("waits") > 100 * F.col("signals"))).alias("unsignaled_flag"))
    return a.select("*", _cls((F.col("pairing_waits") + F.col("pairing_signals") == 0, "NONE"), (F.col("unsignaled_flag") > 0, "STUCK-SIGNALED"), other="PAIRED"))


def _heap_ops(e: DataFrame, *more: str) -> DataFrame:
    """A row for each effect on an address: born or freed; a reallocation has both."""
    h = e.where((F.col("type") == HEAP) & ~((F.col("op") == FREE) & (F.col("addr") == 0)))
    born = F.struct(F.lit(1).alias("k"), F.when(F.col("op") == REALLOC, F.col("new_addr")).otherwise(F.col("addr")).alias("a"), F.lit("alloc").alias("what"))
    gone = F.struct(F.lit(0).alias("k"), F.col("addr").alias("a"), F.when(F.col("op") == REALLOC, "clear").otherwise("free").alias("what"))
    x = F.when(F.col("op") == FREE, F.array(gone)).when(F.col("op") == REALLOC, F.array(gone, born)).otherwise(F.array(born))
    return h.select("pid", "tid", "size", "seq", *more, F.explode(x).alias("x")).select("pid", "tid", "size", "seq", *more, "x.*")


def double_frees(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("pid", "a").orderBy("seq", "k")
    born = F.last(F.when(F.col("what") == "alloc", F.col("size")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _heap_ops(e).select("*", F.lag("what").over(w).alias("was"), F.lag("tid").over(w).alias("by"), born.alias("lost")).where("what = 'free' and was = 'free'")


@report("doublefree")
def doublefree(e):
    hits = double_frees(e).agg(F.count("*").alias("doublefree_total"), F.count_if(F.col("tid") != F.col("by")).alias("doublefree_cross_thread_total"))
    frees = e.where((F.col("type") == HEAP) & (F.col("op") == FREE)).agg(F.count("*").alias("frees_total"))
    return hits.join(frees).select("*", _cls((F.col("doublefree_total") == 0, "CLEAN"), (F.col("doublefree_cross_thread_total") > 0, "RACE"), other="LOGIC"))


def heap_lives(e: DataFrame) -> DataFrame:
    """(a, born, gone, size, tid, comm): each allocation from its record to the next one that touches its address, null where none does."""
    w = Window.partitionBy("a").orderBy("seq", "k")
    ops = _heap_ops(e, "comm").where("a <> 0")
    return ops.withColumn("gone", F.lead("seq").over(w)).where("what = 'alloc'").select("a", F.col("seq").alias("born"), "gone", "size", "tid", "comm")


#: Bits of an arena's size, chunks that are shown of it, and records of a thread before its abort.
ARENA, TOPMOST, RING_SIZE = 26, 5, 8


def abort_victims(e: DataFrame) -> DataFrame:
    """(at, pid, tid, arena, live, victim, victim_bytes, top) of each abort: the arena of its thread's last allocation, how many chunks are live in it, the topmost, which an overrun of the arena's top suspects, and the TOPMOST.

    A chunk is joined to an abort only if it is live at it, in the abort's arena. A thread without allocations has no arena.
    """
    aborts = e.where(F.col("type") == ABORT).select(F.col("seq").alias("at"), "pid", "tid")
    lives = heap_lives(e).withColumn("arena", F.shiftright("a", ARENA))
    last = asof(aborts, lives.select("tid", F.col("born").alias("at"), "arena"), ["tid"], "at", "arena").select("at", "pid", "tid", F.col("asof_arena").alias("arena"))
    alive = last.join(lives.select("arena", "a", "born", "gone", "size", F.col("tid").alias("by"), "comm"), "arena").where("born < at and (gone is null or gone > at)")
    count = alive.groupBy("at").agg(F.count("*").alias("live"), F.max("a").alias("victim"), F.max_by("size", "a").alias("victim_bytes"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("a")))
    top = alive.withColumn("rank", rank).where(F.col("rank") <= TOPMOST).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("rank", "a", "size", "by", "comm"))).alias("top"))
    return last.join(count, "at", "left").join(top, "at", "left").na.fill(0, ["live"])


def abort_rings(e: DataFrame) -> DataFrame:
    """(at, tid, back, kind, op, ts, fd, a, b): the last RING_SIZE heap, map and completed wait records of a thread before each of its aborts, back from 1.

    a and b: address and size, or a wait's result and objects.
    """
    aborts = e.where(F.col("type") == ABORT).select(F.col("seq").alias("at"), "tid")
    done = (F.col("type") == NTSYNC) & F.col("op").isin(WAIT_ANY, WAIT_ALL) & (F.col("result") != ENTRY)
    kind = F.when(F.col("type") == HEAP, "heap").when(F.col("type") == MMAP, "map").otherwise("wait")
    wait = F.col("type") == NTSYNC
    rows = e.where((F.col("type") == HEAP) | (F.col("type") == MMAP) | done).join(aborts.select("tid").distinct(), "tid", "left_semi")
    rows = rows.select("tid", "seq", kind.alias("kind"), "op", "ts", "fd", F.when(wait, F.col("result")).otherwise(F.col("addr")).alias("a"), F.when(wait, F.col("wait_count")).otherwise(F.col("size")).alias("b"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("tid").orderBy("seq")))
    last = asof(aborts, rows.select("tid", F.col("seq").alias("at"), "n"), ["tid"], "at", "n").where("asof_n is not null")
    wanted = last.select("at", "tid", F.explode(F.sequence(F.lit(1), F.lit(RING_SIZE))).alias("back"), "asof_n").withColumn("n", F.expr("asof_n - back + 1"))
    return wanted.join(rows, ["tid", "n"]).select("at", "tid", "back", "kind", "op", "ts", "fd", "a", "b")


@report("abortpm")
def abortpm(e):
    victims = abort_victims(e).agg(F.count("*").alias("aborts_total"), F.max("victim_bytes").alias("victim_bytes"))
    return victims.select("*", _cls((F.col("aborts_total") == 0, "NONE"), other="ABORT"))


@report("signals")
def signals(e):
    end = e.agg(F.max("ts").alias("end"))
    s = e.where(F.col("type") == SIGNAL).join(F.broadcast(end))
    dead = (F.col("op") == 1) & (F.col("signal") != 0) & (F.col("end") - F.col("ts") > 2_000_000_000)
    a = s.agg(F.count_if(F.col("op") == 1).alias("signal_exits_total"), F.count_if(F.col("op") == 0).alias("signal_delivers_total"), F.count_if(dead).alias("midtrace_signal_deaths_total"))
    return a.select("*", _cls((F.col("signal_exits_total") + F.col("signal_delivers_total") == 0, "NO-SIGNALS"), (F.col("midtrace_signal_deaths_total") > 0, "MIDTRACE-DEATH"), other="TEARDOWN-ONLY"))


@report("endstate")
def endstate(e):
    """Threads whose last wait never completed: parked at the end, or gone while parked for KILLED; one that acted more than PARKED after its wait woke, its completion being lost."""
    from weir.sources.trace import RAWSTACK, WAITSTACK

    seen = e.where(F.col("type").isin(NTSYNC, HEAP, IO, SIGNAL, WAITSTACK, RAWSTACK))
    end = seen.agg(F.max("ts").alias("end"), F.count("*").alias("n"))
    threads = seen.groupBy("tid").agg(F.max("ts").alias("last"), F.max(((F.col("type") == SIGNAL) & (F.col("op") == 1)).cast("int")).alias("exited"))
    wait = e.where((F.col("type") == NTSYNC) & F.col("op").isin(WAIT_ANY, WAIT_ALL)).groupBy("tid").agg(F.max_by(F.struct("result", "ts"), "seq").alias("l")).where(F.col("l.result") == ENTRY)
    v = wait.join(threads, "tid").join(F.broadcast(end)).where((F.col("exited") == 0) | (F.col("end") - F.col("l.ts") >= KILLED))
    genuine = (F.col("exited") == 1) | (F.col("last") <= F.col("l.ts") + PARKED)
    a = v.agg(F.count("*").alias("endstate_blocked_threads"), F.count_if(genuine).alias("endstate_stalled_threads"), F.max((F.col("end") - F.col("l.ts")) / 1e9).alias("endstate_longest_s"))
    return end.select("n").join(a).select("endstate_blocked_threads", "endstate_stalled_threads", "endstate_longest_s", _cls((F.col("n") == 0, "NO-THREADS"), (F.col("endstate_blocked_threads") == 0, "NO-PARKED"), (F.col("endstate_stalled_threads") > 0, "STALLED"), other="LOST-COMPLETION"))


@report("iowait")
def iowait(e):
    io = e.where((F.col("type") == IO) & F.col("nr").isin(*BLOCKING)).groupBy("tid").agg(F.max_by("result", "seq").alias("r")).where(F.col("r") == ENTRY)
    return io.agg(F.count("*").alias("parked")).select("parked", _cls((F.col("parked") == 0, "NO-IOWAIT"), other="IOWAIT-PARKED"))


@report("heapstk")
def heapstk(e):
    s = e.where(F.col("type") == HEAPSTACK).groupBy(F.slice("stack", 1, 8).alias("s")).agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("stacks"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples")).select("*", _cls((F.col("stacks") == 0, "NO-HEAPSTACK"), other="HEAPSTACK"))


@report("futex")
def futex(e):
    """Threads whose last act is a futex wait: parked (one try on an address that nobody woke), spinning (50 tries or more, one in less than a tenth of a second), or waiting."""
    seen = e.where(F.col("type").isin(IO, NTSYNC, HEAP, MMAP, SIGNAL))
    end = seen.agg(F.max("ts").alias("end"))
    last = seen.groupBy("tid").agg(F.max("ts").alias("last"))
    f = e.where((F.col("type") == IO) & (F.col("nr") == FUTEX)).withColumn("cmd", F.col("fd").bitwiseAND(127))
    w = Window.partitionBy("tid").orderBy("seq")
    moved = F.coalesce((F.col("count") != F.lag("count").over(w)).cast("int"), F.lit(0))
    runs = f.where(F.col("cmd").isin(*FUTEX_WAITS)).withColumn("moved", moved).withColumn("run", F.sum("moved").over(w)).groupBy("tid", "run").agg(F.count("*").alias("tries"), F.max_by("ts", "seq").alias("ts"), F.max("count").alias("uaddr"))
    wait = runs.groupBy("tid").agg(F.max_by(F.struct("tries", "ts", "uaddr"), "run").alias("l")).select("tid", "l.*")
    wake = f.where(F.col("cmd").isin(*FUTEX_WAKES)).groupBy(F.col("count").alias("uaddr")).agg(F.count("*").alias("wakes"))
    b = wait.join(last, "tid").where(F.col("last") <= F.col("ts") + PARKED).join(wake, "uaddr", "left").na.fill(0, ["wakes"]).join(F.broadcast(end))
    idle = (F.col("tries") <= 1) & (F.col("wakes") == 0)
    spin = ~idle & (F.col("tries") >= 50) & ((F.col("end") - F.col("ts")) / 1e9 / F.col("tries") < 0.1)
    a = b.agg(F.count("*").alias("futex_blocked_threads"), F.count_if(idle).alias("futex_idle_parked"), F.count_if(spin).alias("futex_spinning"), F.max((F.col("end") - F.col("ts")) / 1e9).alias("futex_longest_s"))
    return a.select("*", _cls((F.col("futex_blocked_threads") == 0, "NO-FUTEX-BLOCKED"), (F.col("futex_spinning") > F.col("futex_idle_parked"), "FUTEX-SPIN"), other="FUTEX-PARKED"))


@report("keyedevt")
def keyedevt(e):
    k = e.where(F.col("type") == KEYED)
    wait = k.where("op = 0").groupBy("tid").agg(F.max_by(F.struct("ts", "obj"), "seq").alias("w")).select("tid", "w.*")
    free = k.where("op = 1").groupBy("obj").agg(F.max("ts").alias("released"))
    stuck = wait.join(free, "obj", "left").where("released is null or released < ts")
    return k.agg(F.count("*").alias("n")).join(stuck.agg(F.count("*").alias("keyedevt_wedged_threads"))).select("keyedevt_wedged_threads", _cls((F.col("n") == 0, "NO-KEYED-EVENTS"), (F.col("keyedevt_wedged_threads") == 0, "NO-WEDGED"), other="WEDGED"))


#: Time that a CPU must have been idle for a wake on it to be cold.
COLD = 20_000_000


def cold_wakes(e: DataFrame) -> DataFrame:
    """(cpu, seq, runtime, freq) of tasks that run on a CPU which entered idle COLD or longer before and did not leave it since."""
    w = Window.partitionBy("cpu").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    idle = F.last(F.when(F.col("op") == CPU_IDLE, F.struct("sub", F.col("ts").alias("at"))), ignorenulls=True).over(w)
    s = sched(e, CPU_IDLE, WAKE2RUN).withColumn("idle", idle)
    return s.where((F.col("op") == WAKE2RUN) & (F.col("idle.sub") == 1) & (F.col("ts") - F.col("idle.at") >= COLD)).select("cpu", "seq", "runtime", "freq")


def slowest_quarter(wakes: DataFrame) -> DataFrame:
    """The fourth (rounded down) of wakes (seq, runtime, ...) that took longest; of equally long ones the later. Ranks are counted, not sorted in one task."""
    quarter = F.floor(F.col("n") / 4)
    at = _ranked(wakes, "runtime").agg(F.min(F.when(F.col("upto") > F.col("n") - quarter, F.col("v"))).alias("cut"), F.max(quarter).alias("wanted"))
    slow = wakes.join(F.broadcast(at)).where("runtime >= cut")
    above = slow.agg(F.max("wanted").alias("wanted"), F.count_if(F.col("runtime") > F.col("cut")).alias("above"))
    since = _ranked(slow.where("runtime = cut"), "seq").join(F.broadcast(above)).agg(F.min(F.when(F.col("upto") > F.col("n") - (F.col("wanted") - F.col("above")), F.col("v"))).alias("since"))
    return slow.join(F.broadcast(since)).where("runtime > cut or seq >= since").drop("cut", "wanted", "since")


@report("sched")
def sched_report(e):
    r = sched(e, WAKE2RUN)
    share = r.agg(F.count_if(F.col("runtime") < FAST).alias("fast"), F.count_if(F.col("runtime") >= FLOOR).alias("floored"), F.count_if(F.col("sub") != 0).alias("cross"), F.count_distinct("runtime").alias("wake2run_distinct"))
    q = q_at(r, "runtime", {"p50": 0.5, "p99": 0.99, "p999": 0.999})
    wakes = cold_wakes(e)
    least = wakes.agg(F.min(F.when(F.col("freq") > 0, F.col("freq"))).alias("least"))
    slow = q_at(slowest_quarter(wakes).where("freq > 0"), "freq", {"slow": 0.5}).select("slow")
    cold = q_at(wakes, "runtime", {"p50": 0.5, "p99": 0.99}).join(least).join(slow)
    some = F.col("n") > 0
    cold = cold.select(
        F.when(some, F.col("n")).alias("coldwake_count"), *((F.col(c) / 1e3).alias(f"coldwake_wake2run_us_{c}") for c in ("p50", "p99", "worst")),
        *(F.when(some, F.coalesce(c, F.lit(0))).alias(f"coldwake_freq_{name}_mhz") for c, name in (("least", "min"), ("slow", "slowq"))),
    )
    pct = lambda c: 100.0 * F.col(c) / F.nullif(F.col("n"), F.lit(0))
    mid = 100.0 * (F.col("n") - F.col("fast") - F.col("floored")) / F.nullif(F.col("n"), F.lit(0))
    return share.join(q).join(cold).select(
        "n", *((F.col(c) / 1e3).alias(f"wake2run_us_{c}") for c in ("p50", "p99", "p999", "worst")), pct("fast").alias("wake2run_fast_pct"), mid.alias("wake2run_mid_pct"), pct("floored").alias("wake2run_tickfloor_pct"), pct("cross").alias("wake2run_crossdomain_pct"), "wake2run_distinct", *cold.columns,
        _cls((F.col("n") == 0, "NO-WAKE2RUN"), (F.col("floored") * 2 >= F.col("n"), "TICK-FLOORED"), (F.col("fast") * 10 >= F.col("n") * 9, "FAST"), other="MIXED"),
    )


def idle_strands(e: DataFrame) -> DataFrame:
    """(cpu, gap, pulled) of gaps of STRAND or more between picks on a CPU; pulled if the task that ends it was last picked on another."""
    p = sched(e, PICK).select("cpu", "pid", "ts", "seq")
    p = p.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("cpu").orderBy("seq"))).withColumn("from_cpu", F.lag("cpu").over(Window.partitionBy("pid").orderBy("seq")))
    return p.where(F.col("gap") >= STRAND).select("cpu", "gap", F.coalesce(F.col("from_cpu") != F.col("cpu"), F.lit(False)).alias("pulled"))


@report("work-conservation")
def work_conservation(e):
    """Of PICK records alone: a trace without them has no strands."""
    strands = idle_strands(e)
    a = strands.agg(F.count("*").alias("strand_count"), F.count_if("pulled").alias("pulled")).join(q_at(strands, "gap", {"p50": 0.5, "p99": 0.99}))
    pull = 100.0 * F.col("pulled") / F.nullif(F.col("strand_count"), F.lit(0))
    local = 100.0 * (F.col("strand_count") - F.col("pulled")) / F.nullif(F.col("strand_count"), F.lit(0))
    ms = [(F.col(q) / 1e6).alias(f"idle_strand_ms_{q}") for q in ("p50", "p99", "worst")]
    return a.select("strand_count", *ms, pull.alias("strand_pull_pct"), _cls((F.col("strand_count") == 0, "CONSERVING"), (local >= 66, "LOCAL-REWAKE-GAP"), (pull >= 66, "PULL-CLOSED"), other="MIXED-CLOSE"))


def floored_wakes(e: DataFrame) -> DataFrame:
    """Wakes that waited a tick or more: id, cpu, tid, [wake, run)."""
    return sched(e, WAKE2RUN).where(F.col("runtime") >= FLOOR).select(F.col("seq").alias("id"), "cpu", F.col("pid").alias("wakee"), (F.col("ts") - F.col("runtime")).alias("lo"), F.col("ts").alias("hi"))


@report("placement-race")
def placement_race(e):
    idle = sched(e, CPU_IDLE)
    cpus = e.where((F.col("type") == SCHED) & F.col("cpu").isNotNull()).select("cpu").distinct()
    probes = floored_wakes(e).select("id", F.col("cpu").alias("home"), F.col("lo").alias("ts")).join(F.broadcast(cpus), F.col("home") != F.col("cpu"))
    state = asof(probes, idle.select("cpu", "ts", F.col("sub").alias("idle")), ["cpu"], "ts", "idle")
    each = state.groupBy("id").agg(F.count_if(F.col("asof_idle") == 1).alias("free"))
    a = each.agg(F.count("*").alias("floored_wakes"), F.count_if(F.col("free") > 0).alias("missed"), F.avg(F.when(F.col("free") > 0, F.col("free"))).alias("avg_idle_at_miss"))
    miss = 100.0 * F.col("missed") / F.nullif(F.col("floored_wakes"), F.lit(0))
    return a.join(idle.agg(F.count("*").alias("n_idle"))).select("floored_wakes", miss.alias("placement_miss_pct"), miss.alias("reroutable_pct"), (100.0 - miss).alias("saturated_pct"), "avg_idle_at_miss", _cls((F.col("n_idle") == 0, "NO-IDLE-STREAM"), (F.col("floored_wakes") == 0, "NONE"), (miss >= 66, "PLACEMENT-MISS"), (miss <= 34, "SATURATED"), other="MIXED"))


def pass_overs(e: DataFrame) -> DataFrame:
    """(id, cpu, lo, hi, passed, others, mirror, higher, same, lower, newer, legit, served, lane) of each floored wake.

    passed: picks of other tasks on its CPU while it waited; others: tasks among them; mirror: those from lane 0. served:
    whether the CPU picked the task within a tick of its run, from lane. Against that pick's class a pass-over is
    higher, same or lower, and newer if it has the class but a smaller score; what is higher or not newer, and all where
    nothing served, is legit.
    """
    from weir.operators.temporal import point_in_interval

    wakes = floored_wakes(e).withColumn("lo", F.greatest("lo", F.lit(0)))
    p = picks(e).select("cpu", "pid", "ts", "seq", F.col("sub").alias("lane"), "score")
    until = wakes.select("id", "cpu", F.col("wakee").alias("pid"), F.col("hi").alias("from"), (F.col("hi") + FLOOR + 1).alias("till"))
    served = point_in_interval(p, until, ["cpu", "pid"], "ts", "from", "till", 1 << 27).groupBy("id").agg(F.min_by(F.struct("lane", "score"), F.struct("ts", "seq")).alias("s"))
    served = served.select("id", F.col("s.lane").alias("served_lane"), F.col("s.score").alias("served_score"))
    between = point_in_interval(p, wakes, ["cpu"], "ts", "lo", "hi", 1 << 27).where("pid <> wakee").join(served, "id", "left")
    cls, own = (F.shiftrightunsigned(c, 48) for c in ("score", "served_score"))
    newer = (cls == own) & (F.col("score").bitwiseAND((1 << 48) - 1) < F.col("served_score").bitwiseAND((1 << 48) - 1))
    legit = F.col("served_score").isNull() | (cls > own) | ((cls == own) & ~newer)
    counts = {"mirror": F.col("lane") == 0, "higher": cls > own, "same": cls == own, "lower": cls < own, "newer": newer, "legit": legit}
    each = between.groupBy("id").agg(F.count("*").alias("passed"), F.count_distinct("pid").alias("others"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    out = wakes.join(each, "id", "left").na.fill(0, ["passed", "others", *counts]).join(served, "id", "left")
    return out.select("id", "cpu", "lo", "hi", "passed", "others", *counts, F.col("served_score").isNotNull().alias("served"), F.col("served_lane").alias("lane"))


def censored_strands(e: DataFrame) -> DataFrame:
    """(cpu, dark) of CPUs that are idle when the trace ends, and have been for STRAND or more: what they left waiting never ran, so no wake tells of it."""
    last = sched(e, CPU_IDLE).groupBy("cpu").agg(F.max_by(F.struct("sub", "ts"), "seq").alias("l")).where("l.sub = 1")
    end = e.where(F.col("type") == SCHED).agg(F.max("ts").alias("end"))
    return last.join(F.broadcast(end)).select("cpu", (F.col("end") - F.col("l.ts")).alias("dark")).where(F.col("dark") >= STRAND)


@report("dispatch-stall")
def dispatch_stall(e):
    """A wake that nothing passed over waited for a CPU that was held, or dark: idle for half of the wait or more. Without PICK records lanes and classes are unknown."""
    from weir.operators.temporal import overlap

    spans = idle_spans(e)
    w = pass_overs(e)
    dark = overlap(w.where("passed = 0").select("id", "cpu", "lo", "hi"), spans, ["cpu"], 1 << 27).where("hi > lo and overlap * 2 >= hi - lo").select("id", (F.col("hi") - F.col("lo")).alias("dark"))
    total = lambda *cs: [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cs]
    a = w.join(dark, "id", "left").agg(
        F.count("*").alias("stalled"), F.count_if(F.col("passed") == 0).alias("preempt"), F.count_if("served").alias("n_served"), F.count_if(F.col("served") & (F.col("lane") == 0)).alias("served_mirror"),
        F.count("dark").alias("n_dark"), F.coalesce(F.max("dark"), F.lit(0)).alias("worst_dark"), *total("passed", "others", "mirror", "higher", "same", "lower"),
    )
    q = q_at(w, "passed", {"p99": 0.99}).select("p99").join(q_at(w, "legit", {"legit_p99": 0.99}).select("legit_p99"))
    open_ = censored_strands(e).agg(F.count("*").alias("open"), F.max("dark").alias("worst_open"))
    seen = spans.agg((F.count("*") > 0).alias("idle_seen")).join(sched(e, PICK).agg((F.count("*") > 0).alias("native")))
    any_ = F.col("stalled") > 0
    share = lambda part, of, when=any_: F.when(when, F.coalesce(100.0 * F.col(part) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0)))
    order = F.col("stalled") - F.col("preempt")
    ratio = (F.col("others") / F.col("stalled")) / F.nullif(F.col("passed") / F.nullif(order, F.lit(0)), F.lit(0.0))
    classes, idle = any_ & F.col("native"), any_ & F.col("idle_seen")
    rows = a.join(q).join(open_).join(seen).withColumn("n_held", F.col("preempt") - F.col("n_dark")).withColumn("classed", F.col("higher") + F.col("same") + F.col("lower"))
    return rows.select(
        "stalled", share("preempt", "stalled").alias("dispatch_preempt_pct"), F.when(any_, 100.0 * order / F.col("stalled")).alias("dispatch_order_pct"),
        share("n_dark", "preempt", idle).alias("dispatch_dark_pct"), share("n_held", "preempt", idle).alias("dispatch_held_pct"), F.when(idle, F.col("worst_dark") / 1e6).alias("dispatch_worst_dark_ms"),
        F.when(any_, F.coalesce(F.col("passed") / F.nullif(order, F.lit(0)), F.lit(0.0))).alias("dispatch_avg_passovers"),
        share("mirror", "passed", classes).alias("dispatch_passover_mirror_pct"), share("served_mirror", "n_served", classes).alias("dispatch_served_mirror_pct"),
        *(share(c, "classed", classes).alias(f"dispatch_passover_{c}_class_pct") for c in ("higher", "same", "lower")),
        F.col("p99").alias("dispatch_passover_p99"), F.when(any_, F.coalesce(ratio, F.lit(0.0))).alias("dispatch_concentration_ratio"), share("legit_p99", "p99").alias("dispatch_ceiling_remains_pct"),
        F.nullif("open", F.lit(0)).alias("dispatch_censored_strands"), (F.col("worst_open") / 1e6).alias("dispatch_worst_censored_ms"),
        _cls((F.col("stalled") == 0, "NO-FLOORED"), (F.col("preempt") * 2 >= F.col("stalled"), "PREEMPT-STARVED"), other="ORDER-STARVED"),
    )


@report("kick-latency")
def kick_latency(e):
    end = e.agg(F.max("ts").alias("end"))
    k = sched(e, KICK).select("cpu", "ts", "seq", F.lead("ts").over(Window.partitionBy("cpu").orderBy("seq")).alias("until")).join(F.broadcast(end)).withColumn("until", F.coalesce("until", "end")).drop("end")
    got = asof(k, sched(e, RESCHED).select("cpu", "ts", F.col("ts").alias("at")), ["cpu"], "ts", "at", "forward")
    got = got.withColumn("lat", F.when(F.col("asof_at") <= F.col("until"), F.col("asof_at") - F.col("ts")))
    stop = asof(got.drop("asof_at"), sched(e, TICK_STOP).select("cpu", "ts", F.struct(F.col("ts").alias("t"), "sub").alias("stop")), ["cpu"], "ts", "stop")
    raced = F.col("lat").isNull() & (F.col("asof_stop.sub") == 1) & (F.col("ts") - F.col("asof_stop.t") <= 5_000_000)
    a = stop.agg(F.count("*").alias("kicks_total"), F.count_if(F.col("lat").isNull()).alias("kicks_unanswered"), F.count_if(raced).alias("kicks_tickless_raced"))
    q = q_at(stop, "lat", {"p50": 0.5, "p99": 0.99})
    some = F.col("kicks_total") > 0
    counts = [F.when(some, F.col(c)).alias(c) for c in ("kicks_total", "kicks_unanswered", "kicks_tickless_raced")]
    return a.join(q).select(some.cast("int").alias("kick_captured"), *counts, *((F.col(c) / 1e3).alias(f"kick_resched_us_{c}") for c in ("p50", "p99", "worst")), (100.0 * F.col("kicks_unanswered") / F.nullif(F.col("kicks_total"), F.lit(0))).alias("kick_unanswered_pct"), _cls((F.col("kicks_total") == 0, "NONE"), (F.col("kicks_unanswered") == 0, "ALL-ANSWERED"), (F.col("kicks_tickless_raced") > 0, "UNANSWERED-TICKSTOP-RACE"), other="UNANSWERED"))


def idle_spans(e: DataFrame) -> DataFrame:
    """Idle times by CPU: from the last entry before an exit to that exit; entries without one are none."""
    w = Window.partitionBy("cpu").orderBy("seq")
    i = sched(e, CPU_IDLE).select("cpu", "sub", F.col("ts").alias("blo"), F.lead("ts").over(w).alias("bhi"), F.lead("sub").over(w).alias("then"))
    return i.where("sub = 1 and then <> 1 and bhi > blo").select("cpu", "blo", "bhi")


def strands(e: DataFrame) -> DataFrame:
    """(id, cpu, tid, comm, lo, hi, runtime, dark) of each wait of a CPU's own kernel thread; dark if the CPU was idle for half of it or more."""
    from weir.operators.temporal import overlap

    k = e.where(F.col("type") == KSTRAND).select(F.col("seq").alias("id"), "cpu", "tid", "comm", (F.col("ts") - F.col("runtime")).alias("lo"), F.col("ts").alias("hi"), "runtime")
    return overlap(k, idle_spans(e), ["cpu"], 1 << 27).withColumn("dark", F.col("overlap") * 2 >= F.col("runtime")).drop("overlap")


@report("kstrand")
def kstrand(e):
    a = strands(e).agg(F.count("*").alias("kstrand_events_total"), F.count_if("dark").alias("kstrand_dark"), F.coalesce(F.max(F.when(~F.col("dark"), F.col("runtime")) / 1e6), F.lit(0.0)).alias("kstrand_worst_held_ms"))
    held = F.col("kstrand_events_total") - F.col("kstrand_dark")
    return a.select("*", _cls((F.col("kstrand_events_total") == 0, "NO-STRAND"), (held > F.col("kstrand_dark"), "STRAND-HELD"), (F.col("kstrand_dark") > 0, "STRAND-DARK"), other="STRAND"))


def slices(e: DataFrame) -> DataFrame:
    """Time to the next dispatch of the CPU, below SLICE_MOST."""
    return picks(e).select("cpu", "pid", "seq", "ts", (F.lead("ts").over(Window.partitionBy("cpu").orderBy("ts", "seq")) - F.col("ts")).alias("d")).where((F.col("d") > 0) & (F.col("d") < SLICE_MOST))


#: Stretches of equal time that a trajectory is made of.
STRETCHES = 8


def slice_medians(e: DataFrame) -> DataFrame:
    """(stretch, median) of slices that begin in each eighth of the time between the first and the last; the upper one of two middle values. None of fewer than 16 slices, or of no extent."""
    d = slices(e)
    ends = d.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("slices")).where(F.col("slices") >= 2 * STRETCHES).where("t1 > t0")
    passed = [(F.col("ts") >= F.expr(f"t0 + ((t1 - t0) * {g}) div {STRETCHES}")).cast("int") for g in range(1, STRETCHES)]
    each = ranked_by(d.join(F.broadcast(ends)).select(sum(passed, F.lit(0)).alias("stretch"), "d"), ["stretch"], "d")
    return each.groupBy("stretch").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v"))).alias("median"))


def inversions(v: Column, most: int) -> Column:
    """Share of pairs of an array (3 to most values) that are out of order, as disorder.classify has it; null for other sizes."""
    n = F.size(v)
    falls = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(v, i) < F.get(v, i - 1))
    sampled = F.lit(None).cast("double")
    for size in range(3, most + 1):
        pairs = [(F.get(v, F.lit(a)) > F.get(v, F.lit(b))).cast("int") for a, b in sampled_pairs(size)]
        sampled = F.when(n == size, (sum(pairs[1:], pairs[0]) / len(pairs)).cast("float").cast("double")).otherwise(sampled)
    at = F.get(falls, F.lit(0))
    rotated = (F.size(falls) == 1) & (at < n - 1) & (F.get(v, n - 1) <= F.get(v, F.lit(0)))
    known = F.when(F.size(falls) == 0, 0.0).when(F.size(falls) == n - 1, 1.0).when(rotated, (2.0 * at * (n - at) / (n * (n - 1))).cast("float").cast("double")).otherwise(sampled)
    return F.when(n.between(3, most), known)


@report("slice")
def slice_report(e):
    """The trajectory's inversion: how far medians of eighths of the time are from ascending."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("stretch", "median"))), lambda x: x["median"])
    path = slice_medians(e).agg(path.alias("path")).select(inversions(F.col("path"), STRETCHES).alias("slice_trajectory_inversion"))
    q = q_at(slices(e), "d", {"p50": 0.5, "p99": 0.99}).join(path)
    return q.select(*((F.col(c) / 1e3).alias(f"slice_us_{c}") for c in ("p50", "p99", "worst")), "slice_trajectory_inversion", _cls((F.col("n") == 0, "NO-PICK-STREAM"), (F.col("p99") >= 10 * F.col("p50"), "HEAVY-TAIL"), other="EVEN"))


@report("storm")
def storm(e):
    s = e.where(F.col("type") == STORM).select("kicks", "preempt_kicks", "reenq", "interval_ms", F.when(F.col("interval_ms") > 0, F.col("reenq") * 1000.0 / F.col("interval_ms")).otherwise(0.0).alias("rate"))
    a = s.agg(F.count("*").alias("n"), F.sum("interval_ms").alias("ms"), F.sum("kicks").alias("kicks"), F.sum("preempt_kicks").alias("preempt"), F.sum("reenq").alias("reenq"), F.count_if(F.col("rate") >= STORM_RATE).alias("hot"), F.max(F.floor("rate")).alias("peak"))
    some = F.coalesce(F.col("ms") > 0, F.lit(False))
    each = lambda x: F.when(some, x)
    per_s = lambda c: each(F.col(c) * 1000.0 / F.col("ms"))
    real = (F.col("reenq") > 0) & (F.col("preempt") * 2 >= F.col("reenq"))
    return a.select(some.cast("int").alias("storm_captured"), each(100.0 * F.col("hot") / F.col("n")).alias("storm_pct"), each(F.col("peak")).alias("storm_reenq_per_s_peak"), per_s("kicks").alias("storm_kick_per_s"), per_s("preempt").alias("storm_preempt_kick_per_s"), _cls((~some, "NONE"), (F.col("hot") == 0, "CLEAN"), (real, "REAL-IPI-STORM"), other="IDLE-REENQUEUE-CHURN"))


@report("service")
def service(e):
    s = slices(e).groupBy("pid").agg(F.sum("d").alias("t"))
    top = s.orderBy(F.desc("t"), "pid").limit(5).agg(F.sum("t").alias("five"))
    a = s.agg(F.count("*").alias("service_pids"), F.max("t").alias("top"), F.sum("t").alias("all")).join(top).join(q_at(s, "t", {"p99": 0.99}).select("p99"))
    share = lambda c: 100.0 * F.col(c) / F.nullif(F.col("all"), F.lit(0))
    fair = F.col("p99") * F.col("service_pids") / F.nullif(F.col("all"), F.lit(0))
    return a.select("service_pids", share("top").alias("service_top1_pct"), share("five").alias("service_top5_pct"), fair.alias("service_p99_to_fair"), _cls((F.col("service_pids") == 0, "NO-SERVICE"), (share("top") >= 50, "SKEWED"), other="EVEN"))


@report("wakers")
def wakers(e):
    w = sched(e, WAKEUP).where("secondary >= 0").groupBy(F.col("secondary").alias("waker")).agg(F.count("*").alias("n"))
    m = w.agg(F.count("*").alias("waker_pids"), F.coalesce(F.sum("n"), F.lit(0)).alias("waker_wakes_total"), F.greatest(F.lit(8), F.floor(8 * F.avg("n"))).alias("waker_hot_threshold"))
    hot = w.join(F.broadcast(m)).where("n >= waker_hot_threshold")
    lat = sched(e, WAKE2RUN).join(hot.select(F.col("waker").alias("pid"), F.lit(1).alias("hot")), "pid", "left")
    out = m.join(hot.agg(F.count("*").alias("waker_hot_pids")))
    for who, rows in (("messenger", lat.where("hot = 1")), ("worker", lat.where("hot is null"))):
        q = q_at(rows, "runtime", {"p50": 0.5, "p99": 0.99, "p999": 0.999})
        out = out.join(q.select(*(F.coalesce(F.col(c) / 1e3, F.lit(0.0)).alias(f"waker_{who}_wake2run_us_{c}") for c in ("p50", "p99", "p999"))))
    a, b = F.col("waker_messenger_wake2run_us_p99"), F.col("waker_worker_wake2run_us_p99")
    return out.select("*", _cls((F.col("waker_pids") == 0, "NO-WAKER-EDGES"), ((a > 0) & (b > 0) & (a >= 2 * b), "MESSENGER-CLIFF"), (F.col("waker_hot_pids") == 0, "NO-HOT-WAKERS"), other="HOT-WAKERS"))


@report("locality")
def locality(e):
    """Moves by distance. SCATTERED where a further tier has more moves than the one before it, from the first with any."""
    lines = e.where((F.col("type") == PROVIDER) & (F.col("name") == "cache_topology")).select(F.explode(F.split("payload", "\n")).alias("l"))
    topo = lines.select(*(F.regexp_extract("l", f'[{{,]{k}="([0-9]+)"', 1).try_cast("int").alias(k) for k in ("cpu", "l2", "l3", "socket"))).where("cpu is not null").dropDuplicates(["cpu"])
    s = e.where(F.col("type") == SCHED)
    w = Window.partitionBy("pid").orderBy("seq")
    lane = F.last(F.when(F.col("op") == PICK, F.col("sub")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moves = s.where(F.col("op").isin(PICK, WAKE2RUN)).withColumn("lane", lane).where((F.col("op") == WAKE2RUN) & (F.col("last_cpu") >= 0) & (F.col("last_cpu") != F.col("cpu")))
    moves = moves.select("pid", "ts", "cpu", "last_cpu", "lane", (F.col("ts") - F.lag("ts").over(w)).alias("since"))
    a, b = topo.toDF("cpu", "l2", "l3", "s"), topo.toDF("last_cpu", "l2b", "l3b", "sb")
    tier = F.when(F.col("l2") == F.col("l2b"), 0).when(F.col("l3") == F.col("l3b"), 1).when(F.col("s") == F.col("sb"), 2).when(F.col("s").isNotNull() & F.col("sb").isNotNull(), 3)
    m = moves.join(F.broadcast(a), "cpu", "left").join(F.broadcast(b), "last_cpu", "left").withColumn("tier", tier)
    c = m.agg(F.count("*").alias("moves"), F.count("tier").alias("n"), F.count_if(F.col("lane") > 0).alias("locality_steal_moves"), *(F.count_if(F.col("tier") == k).alias(f"t{k}") for k in range(4)))
    span = s.agg(((F.max("ts") - F.min("ts")) / 1e9).alias("span"))
    q = q_at(moves.where("since > 0"), "since", {"p50": 0.5, "p99": 0.99}).select("p50", "p99")
    local = 100.0 * (F.col("t0") + F.col("t1")) / F.nullif(F.col("n"), F.lit(0))
    scattered = ((F.col("t0") > 0) & (F.col("t1") > F.col("t0"))) | ((F.col("t0") + F.col("t1") > 0) & (F.col("t2") > F.col("t1"))) | ((F.col("t0") + F.col("t1") + F.col("t2") > 0) & (F.col("t3") > F.col("t2")))
    gauges = [F.col(f"t{k}").alias(f"locality_tier_moves_{k}") for k in range(4)] + [local.alias("locality_local_pct"), (F.col("moves") / F.nullif(F.col("span"), F.lit(0.0))).alias("locality_migration_rate_hz")]
    gauges += [F.col("locality_steal_moves"), *((F.col(p) / 1e3).alias(f"locality_intermigration_us_{p}") for p in ("p50", "p99"))]
    return c.join(span).join(q).join(topo.agg(F.count("*").alias("cpus"))).select(*gauges, _cls((F.col("cpus") == 0, "NO-TOPOLOGY"), (F.col("n") == 0, "NONE"), (scattered, "SCATTERED"), (local >= 90, "CACHE-LOCAL"), other="SPREAD"))


@report("classmix")
def classmix(e):
    q = sched(e, ENQUEUE).select("pid", "seq", F.shiftrightunsigned("score", 48).alias("w"))
    return q.agg(F.count("*").alias("n"), F.count_distinct("pid").alias("pids"), F.count_distinct("w").alias("classes")).select("n", "pids", "classes", _cls((F.col("n") == 0, "NO-ENQUEUE"), other="CLASS-MIX"))


@report("field-persist")
def field_persist(e):
    g = sched(e, FIELD_GATE).select("score", "seq", "ts", F.lag("score").over(Window.partitionBy("file").orderBy("seq")).alias("was"), (F.lead("ts").over(Window.partitionBy("file").orderBy("seq")) - F.col("ts")).alias("d"))
    per = g.groupBy("score").agg(F.sum("d").alias("dwell"))
    a = g.agg(F.count("*").alias("field_gate_fires"), F.count_distinct("score").alias("field_distinct_signatures"), F.count_if(F.col("was") != F.col("score")).alias("changes"))
    d = per.agg((100.0 * F.max("dwell") / F.nullif(F.sum("dwell"), F.lit(0))).alias("field_dominant_dwell_pct"))
    return a.join(d).select("field_gate_fires", "field_distinct_signatures", F.greatest(F.col("field_gate_fires") - 1 - F.col("changes"), F.lit(0)).alias("field_rederivations"), "field_dominant_dwell_pct", _cls((F.col("field_gate_fires") == 0, "NO-FIELD-GATE"), (F.coalesce("field_dominant_dwell_pct", F.lit(0.0)) >= 50, "LATCHED"), other="LIVE"))


def syscall(nr: Column) -> Column:
    """The name of a system call, ? for one without."""
    return F.coalesce(F.create_map(*(x for k, v in SUBTYPES[IO].items() for x in (F.lit(k), F.lit(v))))[nr], F.lit("?"))


def io_latencies(e: DataFrame) -> DataFrame:
    """(call, count, p50, p99, worst) of completions that took time, by system call; quantiles by floor index."""
    calls = e.where((F.col("type") == IO) & (F.col("dur") > 0)).select(F.coalesce("nr", F.lit(-1)).alias("nr"), "dur")
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("n")), F.col("v")))
    each = ranked_by(calls, ["nr"], "dur").groupBy("nr").agg(F.max("n").alias("count"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.max("v").alias("worst"))
    return each.select("nr", syscall(F.col("nr")).alias("call"), "count", "p50", "p99", "worst")


@report("iolat")
def iolat(e):
    """Gauges by system call as well; calls without a name are told by their number, ?<nr>."""
    q = q_at(e.where((F.col("type") == IO) & (F.col("dur") > 0)), "dur", {"p50": 0.5, "p99": 0.99})
    name = F.when(F.col("call") == "?", F.concat(F.lit("?"), F.col("nr").cast("string"))).otherwise(F.col("call"))
    gauge = lambda what, v: F.struct(F.concat(F.lit("iolat_"), name, F.lit(f"_{what}")).alias("k"), v.cast("double").alias("v"))
    pairs = F.array(gauge("count", F.col("count")), *(gauge(f"{c}_ms", F.col(c) / 1e6) for c in ("p50", "p99", "worst")))
    by = io_latencies(e).agg(F.coalesce(F.map_from_entries(F.flatten(F.collect_list(pairs))), F.create_map().cast("map<string,double>")).alias("labelled"))
    return q.join(by).select("n", *((F.col(c) / 1e6).alias(f"iolat_{c}_ms") for c in ("p50", "p99", "worst")), "labelled", _cls((F.col("n") == 0, "NO-IO"), other="IO"))


def seats(e: DataFrame) -> DataFrame:
    """(pid, stints, wakes, ratio, cpu_share) of tasks switched in eight times or more: switches a wake, and the share of its most frequent CPU."""
    s = sched(e, SWITCH_IN).groupBy("pid", "cpu").agg(F.count("*").alias("k")).groupBy("pid").agg(F.sum("k").alias("stints"), F.max("k").alias("seat"))
    w = sched(e, WAKE2RUN).groupBy("pid").agg(F.count("*").alias("wakes"))
    r = s.where("stints >= 8").join(w, "pid", "left").na.fill(0, ["wakes"])
    return r.select("pid", "stints", "wakes", (F.col("stints") / F.greatest("wakes", F.lit(1))).alias("ratio"), (F.col("seat") / F.col("stints")).alias("cpu_share"))


@report("seat")
def seat(e):
    f = sched(e, WAKE2RUN).agg(F.coalesce(F.count_if(F.col("runtime") < FLOOR) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("seat_floored_wake_ratio"))
    return seats(e).agg(F.count("*").alias("n"), F.count_if(F.col("ratio") > 1.5).alias("seat_self_preempting")).join(f).select("seat_floored_wake_ratio", "seat_self_preempting", _cls((F.col("n") == 0, "NONE"), (F.col("seat_self_preempting") > 0, "SELF-PREEMPTING"), other="SEATED"))


def offenders(e: DataFrame) -> DataFrame:
    """(kind, id, obj, metric, value, sev) of what the reports blame; weir.operators.decode.rank_offenders puts them in order."""
    spins_ = spin_offenders(e).select(F.lit("spin").alias("kind"), F.concat(F.lit("tid="), F.col("tid").cast("string")).alias("id"), F.concat(F.lit("obj="), F.col("obj").cast("string")).alias("obj"), F.lit("waits_per_s").alias("metric"), F.col("rate").alias("value"), "sev")
    strands = idle_strands(e).agg(F.count("*").alias("n"), F.count_if("pulled").alias("pulled")).where("n > 0").withColumn("who", F.lit("-"))
    named = lambda df, kind, prefix, key, metric, value, sev: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit("").alias("obj"), F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"), sev.cast("int").alias("sev"))
    churn = seats(e).where("ratio > 1.5").orderBy(F.desc("ratio"), "pid").limit(8)
    stuck = paired(e).where("waits >= 1000 and waits > 100 * signals")
    hit = F.when(F.col("victim").isNull(), "unattributed").otherwise(F.concat(F.lit("addr="), F.col("victim").cast("string")))
    aborted = abort_victims(e).select(F.lit("abort").alias("kind"), F.concat(F.lit("tid="), F.col("tid").cast("string")).alias("id"), hit.alias("obj"), F.lit("victim_bytes").alias("metric"), F.coalesce(F.col("victim_bytes").cast("double"), F.lit(0.0)).alias("value"), F.lit(2).alias("sev"))
    freed = double_frees(e).groupBy("a").agg(F.max("lost").alias("bytes"))
    late = e.where(F.col("type") == KSTRAND).groupBy("tid").agg((F.max("runtime") / 1e6).alias("ms"))
    hot = e.where((F.col("type") == STORM) & (F.col("interval_ms") > 0)).agg(F.max(F.floor(F.col("reenq") * 1000.0 / F.col("interval_ms"))).alias("peak")).where(F.col("peak") >= STORM_RATE).withColumn("who", F.lit("scheduler"))
    out = spins_.union(aborted).union(named(churn, "self-preempt", "tid=", "pid", "stint_wake_ratio", "ratio", F.when(F.col("ratio") > 4, 2).when(F.col("ratio") > 2, 1).otherwise(0)))
    out = out.union(named(stuck, "unsignaled", "fd=", "fd", "waits", "waits", F.lit(2))).union(named(freed, "double-free", "addr=", "a", "bytes", "bytes", F.lit(2)))
    out = out.union(named(late, "kthread-strand", "tid=", "tid", "held_ms", "ms", F.when(F.col("ms") >= 100, 2).otherwise(1)))
    out = out.union(named(strands, "idle-strand", "", "who", "strand_count", "n", F.expr("case when n >= 10 and n > 2 * pulled then 2 when n >= 3 then 1 else 0 end")))
    return out.union(named(hot, "scx-storm", "", "who", "reenq_per_s", "peak", F.when(F.col("peak") > 5 * STORM_RATE, 2).otherwise(1)))


def scaling(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of WAKE2RUN records as dispatch-rate and those of them from another domain as migration-rate: (series, h, se, rs, decades), and the tail of the latter's bursts."""
    line = fractal.timeline(sched(e, WAKE2RUN), dispatch_rate=F.lit(True), migration_rate=F.col("sub") != 0)
    long = line.where(F.col("bins") >= fractal.LEAST)
    fits = fractal.dfa(long).select("series", F.col("slope").alias("h"), F.col("error").alias("se"), "decades")
    return fits.join(fractal.rescaled_range(long).select("series", F.col("slope").alias("rs")), "series", "left"), fractal.tail(fractal.bursts(line.where("series = 'migration-rate'")))


@report("fractal")
def fractal_report(e):
    """A series is persistent, or the opposite, where its exponent is two standard errors from a half."""
    fits, avalanches = scaling(e)
    gauge = lambda name, value: F.struct(F.concat(F.lit(f'fractal_{name}{{series="'), "series", F.lit('"}')).alias("k"), value.cast("double").alias("v"))
    pairs = F.array(gauge("hurst_dfa", F.col("h")), gauge("hurst_dfa_se", F.col("se")), gauge("hurst_rs", F.col("rs")), gauge("dimension", 2 - F.col("h")), gauge("decades", F.col("decades")))
    a = fits.agg(
        F.count_if(F.col("h") - 2 * F.col("se") > 0.5).alias("up"), F.count_if(F.col("h") + 2 * F.col("se") < 0.5).alias("down"),
        F.coalesce(F.map_from_entries(F.flatten(F.collect_list(pairs))), F.create_map().cast("map<string,double>")).alias("labelled"),
    )
    span = sched(e, WAKE2RUN).agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("span"))
    tails = avalanches.agg(F.max("avalanches").alias("fractal_avalanches"), F.max("slope").alias("fractal_avalanche_slope"))
    cls = _cls((F.col("n") == 0, "NO-SCHED"), (F.col("span") == 0, "ZERO-DURATION"), (F.col("up") > 0, "PERSISTENT"), (F.col("down") > 0, "ANTI-PERSISTENT"), other="UNCORRELATED")
    return a.join(span).join(tails).select("fractal_avalanches", "fractal_avalanche_slope", "labelled", cls)


def _kernel_report(name: str, fields: str, make) -> None:
    """A report on binned counts: the bins, whose number is fixed, are one group."""
    @report(name)
    def run(e):
        import numpy as np
        import pandas as pd

        s = e.where(F.col("type") == SCHED).select("ts")
        ends = s.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
        binned = s.join(F.broadcast(ends)).groupBy(F.expr(make["bin"]).alias("bin")).agg(F.count("*").alias("n"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
        # A row that is always there gives the empty class its row.
        rows = binned.union(e.sparkSession.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))

        def one(g: pd.DataFrame) -> pd.DataFrame:
            b = g[g["bin"] >= 0]
            counts = np.bincount(b["bin"], b["n"]) if len(b) else np.zeros(0)
            return pd.DataFrame([make["kernel"](counts, int(b.t1.iloc[0] - b.t0.iloc[0]) if len(b) else 0)])

        return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, f"class string, {fields}")


def _profile(counts, span):
    from weir.functions import kernels as K

    if len(counts) < 24:
        return {"class": "NO-PROFILE", "matrix_profile_discord_score": 0.0, "matrix_profile_mean": 0.0, "matrix_profile_discord_ms": 0.0}
    best, _ = K.matrix_profile(counts, 8)
    top, mean = float(best.max()), float(best.mean())
    ratio = top / mean if mean else 0.0
    return {"class": "DISCORD-STRONG" if ratio >= 3 else "DISCORD" if ratio >= 1.5 else "UNIFORM", "matrix_profile_discord_score": top, "matrix_profile_mean": mean, "matrix_profile_discord_ms": float(best.argmax()) * span / 128 / 1e6}


_kernel_report("matrix-profile", "matrix_profile_discord_score double, matrix_profile_mean double, matrix_profile_discord_ms double", {"bin": "least((ts - t0) div greatest((t1 - t0) div 128, 1), 127L)", "kernel": _profile})


def completeness(e: DataFrame) -> DataFrame:
    """Observed share of records by the last DROPS snapshot; null without one."""
    lost = F.expr("aggregate(max_by(dropped, seq) filter (where type = 20), 0L, (a, x) -> a + x)")
    return e.agg(F.count_if(F.col("type") != DROPS).alias("observed"), lost.alias("dropped")).select("*", (F.col("observed") / (F.col("observed") + F.col("dropped"))).alias("completeness"))


#: Reports that row qualifiers narrow; the others need the context of all tasks.
QUALIFIED = ("sched", "dispatch-stall", "wakers", "fractal", "locality", "signals")


def qualify(e: DataFrame, signal: int | None = None, pid: int | None = None, tid: int | None = None, comm: str | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """The records of one signal, process, thread, (part of a) name or time [from, to); for the reports in QUALIFIED. A record without a field that is asked for goes."""
    keep = F.lit(True)
    for column, value in (("signal", signal), ("pid", pid), ("tid", tid)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    if comm is not None:
        keep = keep & F.contains("comm", F.lit(comm))
    if window is not None:
        keep = keep & (F.col("ts") >= window[0]) & (F.col("ts") < window[1])
    return e.where(keep)


def run_reports(events: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The chosen reports of one event table. Each reads it by type: keep the events as Parquet (see read_traces) rather than parse logs for each."""
    out = None
    for n in names or list(REPORTS):
        r = REPORTS[n](events)
        out = r if out is None else out.union(r)
    return out


def to_text(reports: DataFrame) -> DataFrame:
    """A sentence a report: its class, and its gauges in the order of their names."""
    said = F.transform(F.filter(F.array_sort(F.map_entries("gauges")), lambda g: g["value"].isNotNull()), lambda g: F.concat(g["key"], F.lit(" "), F.regexp_replace(F.format_number(g["value"], 3), ",", "")))
    return reports.select("report", F.concat(F.lit("VERDICT: "), "report", F.lit(" is "), "class", F.when(F.size(said) > 0, F.concat(F.lit(": "), F.array_join(said, ", "))).otherwise("")).alias("line"))


def to_prometheus(reports: DataFrame, prefix: str = "weir_") -> DataFrame:
    """Gauge lines of the same rows, labels kept, each family under its HELP and TYPE lines."""
    g = reports.select("report", F.explode("gauges").alias("key", "value")).where("value is not null")
    g = g.select("report", F.concat(F.lit(prefix), F.regexp_replace(F.regexp_extract("key", "^([^{]*)", 1), "[^A-Za-z0-9_]", "_")).alias("name"), F.regexp_extract("key", "[{](.*)[}]$", 1).alias("labels"), "value")
    label = F.concat(F.when(F.col("labels") != "", F.concat("labels", F.lit(","))).otherwise(""), F.lit('report="'), "report", F.lit('"'))
    line = F.struct("labels", "report", F.concat("name", F.lit("{"), label, F.lit("} "), F.col("value").cast("string")).alias("line"))
    family = g.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    head = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), F.regexp_replace(F.substring("name", len(prefix) + 1, 200), "_", " ")), F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")))
    return family.select(F.explode(F.concat(head, "lines")).alias("line"))


def to_json(reports: DataFrame) -> DataFrame:
    """A JSON envelope a report: name, class, verdict sentence and gauges."""
    return reports.join(to_text(reports).withColumnRenamed("line", "verdict"), "report").select(F.to_json(F.struct("report", "class", "verdict", "gauges")).alias("json"))


def compare_golden(reports: DataFrame, golden: DataFrame, tolerance_pct: float = 10.0, floor: float = 0.0) -> DataFrame:
    """(report, gauge, ok): classes exactly, gauges within max(|v| * tolerance, floor); null where the golden asks for what is missing."""
    cls = golden.select("report", F.col("class").alias("want")).join(reports, "report", "left").select("report", F.lit("class").alias("gauge"), (F.col("class") == F.col("want")).alias("ok"))
    want = golden.select("report", F.explode("gauges").alias("gauge", "want"))
    got = reports.select("report", F.explode("gauges").alias("gauge", "got"))
    return cls.union(want.join(got, ["report", "gauge"], "left").select("report", "gauge", (F.abs(F.col("got") - F.col("want")) <= F.greatest(F.abs("want") * tolerance_pct / 100, F.lit(floor))).alias("ok")))
