"""TCP and IP header features that follow the order of packets, and the connection state machine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.functions.query import flags_text as flags_text
from rillflow.operators.folds import Fold, ordered_fold
from rillflow.types import STATE_TIMEOUT, TCP_FLAGS

FIN, SYN, RST, ACK = TCP_FLAGS["F"], TCP_FLAGS["S"], TCP_FLAGS["R"], TCP_FLAGS["A"]


def bits(column: Column, mask: int, every: bool) -> Column:
    """All or any of the mask's bits."""
    masked = column.bitwiseAND(F.lit(mask))
    return masked == mask if every else masked != 0


def _before(column: str, key: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*key).orderBy(*order))


def window_moves(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """How often the window grows and shrinks, and how often its direction turns. A flow begins in the shrinking direction, so a first move up is a turn; one whose window never moves has zeros."""
    w = Window.partitionBy(*key).orderBy(*order)
    moved = packets.withColumn("__d", F.signum(F.col(column) - _before(column, key, order)).cast("int"))
    past = F.last(F.when(F.col("__d") != 0, F.col("__d")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turned = moved.withColumn("__t", (F.col("__d") != 0) & (F.col("__d") != F.coalesce(past, F.lit(-1))))
    return turned.groupBy(*key).agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("ups", F.col("__d") > 0), ("downs", F.col("__d") < 0), ("turns", F.col("__t")))))


def changes(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """Least and largest value, and how often it differs from the packet before."""
    changed = packets.withColumn("__c", F.when(F.col(column) != _before(column, key, order), 1).otherwise(0))
    return changed.groupBy(*key).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.sum("__c").alias("changes"))


def rolling_delta(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str], modulus: int) -> DataFrame:
    """Least and largest step of a wrapping counter, and how often it wraps."""
    before = _before(column, key, order)
    step = packets.withColumns({"__s": F.pmod(F.col(column) - before, F.lit(modulus)), "__r": F.when(F.col(column) < before, 1).otherwise(0)})
    return step.groupBy(*key).agg(F.min("__s").alias("min_step"), F.max("__s").alias("max_step"), F.sum("__r").alias("rollovers"))


def sequence_faults(packets: DataFrame, key: Sequence[str], sequence: str, length: str, order: Sequence[str]) -> DataFrame:
    """Packets whose number isn't the one expected after the packet before: later ones (gaps) and earlier ones (repeats)."""
    expected = _before(sequence, key, order) + _before(length, key, order)
    faults = packets.withColumn("__off", F.col(sequence) - expected)
    return faults.groupBy(*key).agg(F.sum(F.when(F.col("__off") > 0, 1).otherwise(0)).alias("gaps"), F.sum(F.when(F.col("__off") < 0, 1).otherwise(0)).alias("repeats"))


def running_average(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """Last value of the running mean and of the running mean distance from it (round-trip time and jitter)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    means = packets.withColumn("__m", F.avg(column).over(w)).withColumn("__j", F.abs(F.col(column) - F.col("__m")))
    return means.groupBy(*key).agg(F.round(F.avg(column), 4).alias("rtt"), F.round(F.avg("__j"), 4).alias("jitter"))


def smoothed(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str], keep: float = 0.7) -> DataFrame:
    """First-order filter over the values in order, seeded with the first of them, in closed form: the value ``r`` steps back counts ``keep`` to the power r."""
    back = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order)))
    rows = packets.select(*key, F.col(column).cast("double").alias("__x"), *order, back.alias("__r"))
    total = F.sum(F.col("__x") * (1 - keep) * F.pow(F.lit(keep), F.col("__r") - 1)) + F.max_by("__x", "__r") * F.pow(F.lit(keep), F.count("*"))
    return rows.groupBy(*key).agg(F.round(total, 4).alias("smoothed"))


def scanners(flows: DataFrame, src: str, dst: str, pkts: str, flags: str, anomalies: str, scan_bits: int) -> DataFrame:
    """Flows by source that look like scans: no answer, fewer than five packets, and SYN, RST or a scan anomaly."""
    hit = (F.col(pkts) < 5) & (bits(F.col(flags), SYN | RST, False) | bits(F.col(anomalies), scan_bits, False))
    return flows.where(hit).groupBy(src).agg(F.count("*").alias("scan_flows"), F.countDistinct(dst).alias("targets"))


@dataclass
class Side:
    """What one direction of a connection has shown."""

    state: str = "new"
    anomaly: int = 0
    packets: int = 0
    last: int = 0
    syn: int | None = None  # sequence numbers
    fin: int | None = None
    syn_acked: bool = False
    fin_acked: bool = False
    lone_fin: bool = False

    def next_syn(self) -> int:
        return (self.syn or 0) + 1


class Connection:
    """A connection watched from its middle: each direction has a state and anomaly bits of its own, and may change the other's."""

    # Anomaly bits.
    BAD_OPEN, BAD_CLOSE, BAD_FLAGS, AFTER_CLOSE, AFTER_RESET, RESET_SENT, EVIL = 0x01, 0x02, 0x04, 0x08, 0x10, 0x40, 0x80

    def __init__(self) -> None:
        self.sides: dict[str, Side] = {}

    def packet(self, way: str, flags: int, seq: int = 0, ack: int = 0, time: int = 0) -> None:
        me = self.sides.setdefault(way, Side())
        peer = next((s for w, s in self.sides.items() if w != way), None)
        me.packets, me.last = me.packets + 1, time
        if flags & 0x3F in (0, 0x29):
            me.anomaly |= self.EVIL
        getattr(self, f"_{me.state}")(me, peer, flags, seq, ack)

    @staticmethod
    def _mark(bits: int, *sides: Side | None) -> None:
        for s in sides:
            if s:
                s.anomaly |= bits

    @classmethod
    def _enter(cls, state: str, bits: int, *sides: Side | None) -> None:
        cls._mark(bits, *sides)
        for s in sides:
            if s:
                s.state = state

    @staticmethod
    def _confirm_fin(peer: Side | None, ack: int) -> None:
        if peer and peer.fin is not None and ack == peer.fin + 1:
            peer.fin_acked = True

    def _reset_by(self, me: Side, peer: Side | None, bits: int) -> None:
        self._enter("reset", bits, me, peer)
        me.anomaly |= self.RESET_SENT

    def _new(self, me: Side, peer: Side | None, flags: int, seq: int, ack: int) -> None:
        kind = flags & (ACK | RST | SYN | FIN)
        answers = peer is not None and ack == peer.next_syn()
        if kind in (SYN, SYN | ACK):
            me.syn = seq
            if kind == SYN:
                return
            if answers:
                peer.syn_acked = True
            else:
                self._enter("established", self.BAD_OPEN, me, peer)
        elif kind == ACK and peer:
            if answers:
                peer.syn_acked = True
                if me.syn_acked:
                    self._enter("established", 0, me, peer)
            else:
                self._enter("established", self.BAD_OPEN, me, peer)
        elif flags & RST:
            refusal = kind == RST | ACK and peer
            self._reset_by(me, peer, 0 if refusal else self.BAD_OPEN)
            if not peer:
                me.anomaly |= self.EVIL
        elif kind == FIN | ACK:
            me.fin, me.state = seq, "closing"
            self._mark(self.BAD_OPEN, me, peer)
            me.lone_fin = me.lone_fin or peer is None
            self._confirm_fin(peer, ack)
        elif kind == FIN:
            me.anomaly |= self.EVIL
        else:
            self._enter("established", self.BAD_OPEN, me, peer)

    def _established(self, me: Side, peer: Side | None, flags: int, seq: int, ack: int) -> None:
        if flags & (SYN | ACK) != ACK:
            self._mark(self.BAD_FLAGS, me, peer)
        if flags & FIN:
            me.fin, me.state = seq, "closing"
            if flags & ACK:
                self._confirm_fin(peer, ack)
        if flags & RST:
            self._reset_by(me, peer, self.BAD_CLOSE)

    def _closing(self, me: Side, peer: Side | None, flags: int, seq: int, ack: int) -> None:
        if flags & RST:
            self._reset_by(me, peer, self.BAD_CLOSE)
        if flags & ACK:
            self._confirm_fin(peer, ack)
        if me.fin_acked and peer and peer.fin_acked:
            self._enter("closed", 0, me, peer)

    def _closed(self, me: Side, peer: Side | None, flags: int, seq: int, ack: int) -> None:
        me.anomaly |= self.AFTER_CLOSE
        if flags & RST:
            self._reset_by(me, peer, self.BAD_CLOSE)

    def _reset(self, me: Side, peer: Side | None, flags: int, seq: int, ack: int) -> None:
        me.anomaly |= self.AFTER_RESET

    def idle(self, now: int) -> bool:
        """Whether every direction has been silent beyond the timeout of its state."""
        return bool(self.sides) and all(now - s.last >= STATE_TIMEOUT[s.state] * 1_000_000 for s in self.sides.values())

    def end(self) -> dict[str, Side]:
        """The directions with their last bits: what a whole opening or teardown lacks, and a teardown out of nothing."""
        sides = list(self.sides.values())
        whole = lambda *parts: len(sides) == 2 and all(p is not None and p is not False for p in parts)
        opened = whole(*(x for s in sides for x in (s.syn, s.syn_acked)))
        closed = whole(*(x for s in sides for x in (s.fin, s.fin_acked)))
        for s in sides:
            self._mark((0 if opened else self.BAD_OPEN) | (0 if closed else self.BAD_CLOSE) | (self.EVIL if s.lone_fin and not closed else 0), s)
        return self.sides


class _Connections(Fold):
    def __init__(self) -> None:
        self.conn, self.number = Connection(), 0

    def add(self, way: str, flags: int, seq: int, ack: int, t: int) -> list[tuple]:
        done = []
        if self.conn.idle(t):
            done = self.end()
            self.conn, self.number = Connection(), self.number + 1
        self.conn.packet(way, int(flags), int(seq), int(ack), t)
        return done

    def end(self) -> list[tuple]:
        return [(self.number, way, s.packets, s.state, s.anomaly) for way, s in sorted(self.conn.end().items())]


def connection_states(packets: DataFrame, key: Sequence[str], way: str = "way", flags: str = "tcp_flags", seq: str = "tcp_seq", ack: str = "tcp_ack", time_us: str = "t_us", order: str = "pkt_no") -> DataFrame:
    """Folds the packets of each key in time order; silence of both directions beyond the timeouts of their states begins a new connection.

    One row per connection and direction: its ordinal, packets, last state and anomaly bits.
    """
    return ordered_fold(packets, key, [time_us, order], [way, flags, seq, ack, time_us], _Connections, "conn long, way string, pkts long, state string, anomaly long")
