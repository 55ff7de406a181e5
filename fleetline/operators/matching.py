"""The best trip of each ping among all that pass near it, found without making the pairs.

A group is the pings and the timetable of one route in one bucket of the clock.  What a visit
can be worth to a ping is known before its trip is walked, and falls with lateness on either
side.  So the visits of a stop, sorted by time, are searched for the nearest before and after
the ping; the best of these bounds what any trip can reach.  The visits that reach the bound
stand side by side, the smallest trip id among them is a range minimum, and its trip is
walked.  If the walk holds to the bound, that trip is the answer; else all trips of the
ping's window are walked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from fleetline.functions.geo import EARTH_M

RESULT = "id long, trip_id string, stop_id string, stop_sequence int, late_sec double, dist_m double, confidence double"
_SCHEMA = pa.schema([("id", pa.int64()), ("trip_id", pa.string()), ("stop_id", pa.string()), ("stop_sequence", pa.int32()), ("late_sec", pa.float64()), ("dist_m", pa.float64()), ("confidence", pa.float64())])
#: pings searched at once
CHUNK = 8192


@dataclass(frozen=True)
class Rules:
    max_m: float
    early_min: int
    late_min: int
    min_confidence: float


def confidence(late: np.ndarray, dist: np.ndarray, r: Rules) -> np.ndarray:
    """Mean of nearness in time and place, 0.1 more from two minutes early to ten late, 0.1 less when earlier."""
    minutes = late / 60
    bonus = np.where((minutes >= -2) & (minutes <= 10), 0.1, np.where(minutes < -2, -0.1, 0.0))
    return np.clip(((1 - np.abs(minutes) / r.late_min) + (1 - dist / r.max_m)) / 2 + bonus, 0.0, 1.0)


def _reach(bound: np.ndarray, dist: np.ndarray, r: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Seconds (late, early) within which a visit at ``dist`` is worth at least ``bound``; a hair wider, never narrower."""
    spare = lambda bonus: r.late_min * (2 - dist / r.max_m + 2 * bonus - 2 * bound)
    late = np.maximum(np.minimum(spare(0.1), 10.0), spare(0.0))
    early = np.maximum(np.minimum(spare(0.1), 2.0), spare(-0.1))
    return np.minimum(late, r.late_min) * 60 + 1e-6, np.minimum(early, r.early_min) * 60 + 1e-6


def _distances(lat: np.ndarray, lon: np.ndarray, s_lat: np.ndarray, s_lon: np.ndarray) -> np.ndarray:
    """Metres from each ping to each stop, to the micrometre."""
    a, b, c, d = np.radians(lat)[:, None], np.radians(s_lat)[None, :], lon[:, None], s_lon[None, :]
    h = np.sin(np.radians(s_lat[None, :] - lat[:, None]) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(d - c) / 2) ** 2
    return np.round(2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))), 6)


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of each row's value among them)."""
    coded = column.combine_chunks().dictionary_encode()
    values = np.array(coded.dictionary.to_pylist(), dtype=object)
    order = np.argsort(values, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[coded.indices.to_numpy(zero_copy_only=False)]


class Timetable:
    """Visits of one route's trips, sorted by trip to be walked and by stop and time to be searched."""

    def __init__(self, trip: np.ndarray, stop: np.ndarray, seq: np.ndarray, sec: np.ndarray):
        order = np.lexsort((-sec, stop, seq, trip))
        self.trip, self.stop, self.seq, self.sec = trip[order], stop[order], seq[order], sec[order]
        self.trips, self.first, self.length = np.unique(self.trip, return_index=True, return_counts=True)
        self.low, self.span = int(self.sec.min()) - 1, int(self.sec.max() - self.sec.min()) + 3
        by = np.lexsort((self.trip, self.sec, self.stop))
        self.s_sec, self.s_stop = self.sec[by], self.stop[by]
        self.keys = self.s_stop * self.span + (self.s_sec - self.low)
        self.mins = [self.trip[by]]  # of 1, 2, 4, ... entries from each place
        while 2 ** len(self.mins) <= len(by):
            half, last = 2 ** (len(self.mins) - 1), self.mins[-1]
            self.mins.append(np.minimum(last[:-half], last[half:]))

    def place(self, stop: np.ndarray, sec: np.ndarray, side: str) -> np.ndarray:
        """Where a whole second would stand among the visits of a stop."""
        return np.searchsorted(self.keys, stop * self.span + np.clip(sec - self.low, 0, self.span - 1).astype(np.int64), side)

    def smallest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest trip of entries [a, b); of none a number beyond all."""
        out = np.full(len(a), np.iinfo(np.int64).max)
        n = b - a
        for level, mins in enumerate(self.mins):
            on = (n >= 2**level) & (n < 2 ** (level + 1))
            out[on] = np.minimum(mins[a[on]], mins[b[on] - 2**level])
        return out

    def walk(self, t: np.ndarray, dist: np.ndarray, row: np.ndarray, trip: np.ndarray, r: Rules) -> tuple[np.ndarray, np.ndarray]:
        """(visit held, -1 if none; confidence) of each pair of a ping (``row`` of ``t`` and ``dist``) and a trip (index of ``trips``).

        The visits near in place and time are walked in order; one takes over if its biased
        score (early costs more than late) is below the plain score of the one held.
        """
        held, score = np.full(len(row), -1), np.full(len(row), np.inf)
        first, length, at = self.first[trip], self.length[trip], t[row]
        for k in range(int(length.max()) if len(row) else 0):
            v = np.where(k < length, first + k, first)
            late, d = at - self.sec[v], dist[row, self.stop[v]]
            minutes = late / 60
            off, place = np.abs(minutes), d / r.max_m
            near = (k < length) & (d <= r.max_m) & (late >= -r.early_min * 60) & (late <= r.late_min * 60)
            time = np.where(off <= 2, off / 20, np.where(minutes < 0, 0.3 + off / r.late_min * 0.7, minutes / r.late_min * 0.5))
            on = near & ((held < 0) | ((time + place) / 2 < score))
            held, score = np.where(on, v, held), np.where(on, (off / r.late_min + place) / 2, score)
        v = np.maximum(held, 0)
        return held, np.where(held < 0, -1.0, confidence(at - self.sec[v], dist[row, self.stop[v]], r))

    def best(self, t: np.ndarray, dist: np.ndarray, r: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of pings with a match, visit held, confidence): most confident, then smallest trip."""
        row, stop = np.nonzero(dist <= r.max_m)
        d, at = dist[row, stop], t[row]
        pos = self.place(stop, np.floor(at), "right")
        bound = np.full(len(t), -1.0)
        for i in (pos - 1, pos):
            v = np.clip(i, 0, len(self.keys) - 1)
            late = at - self.s_sec[v]
            ok = (i == v) & (self.s_stop[v] == stop) & (late >= -r.early_min * 60) & (late <= r.late_min * 60)
            np.maximum.at(bound, row[ok], confidence(late[ok], d[ok], r))
        able = bound[row] > r.min_confidence
        row, stop, d, at = row[able], stop[able], d[able], at[able]
        late, early = _reach(bound[row], d, r)
        on = (late >= 0) | (early >= 0)
        a = self.place(stop, np.ceil(at - np.maximum(late, 0)), "left")
        b = self.place(stop, np.floor(at + np.maximum(early, 0)), "right")
        pick = np.full(len(t), np.iinfo(np.int64).max)
        np.minimum.at(pick, row[on], self.smallest(a[on], np.maximum(a, b)[on]))
        rows = np.nonzero(pick < np.iinfo(np.int64).max)[0]
        trip = np.searchsorted(self.trips, pick[rows])
        held, conf = self.walk(t, dist, rows, trip, r)
        for i in np.nonzero(conf != bound[rows])[0]:  # the trip holds to another visit than its best
            held[i], conf[i] = self._every(t, dist, rows[i], r)
        ok = conf > r.min_confidence
        return rows[ok], held[ok], conf[ok]

    def _every(self, t: np.ndarray, dist: np.ndarray, row: int, r: Rules) -> tuple[int, float]:
        """The best of all trips that a ping's window holds."""
        near = np.nonzero(dist[row] <= r.max_m)[0]
        at = np.full(len(near), t[row])
        a, b = self.place(near, np.ceil(at - r.late_min * 60), "left"), self.place(near, np.floor(at + r.early_min * 60), "right")
        found = np.unique(np.concatenate([self.mins[0][x:y] for x, y in zip(a, b)]))
        held, conf = self.walk(t, dist, np.full(len(found), row), np.searchsorted(self.trips, found), r)
        best = int(np.argmax(conf))  # trips ascend: the first of equals is the smallest
        return held[best], conf[best]


def match_group(pings: pa.Table, visits: pa.Table, rules: Rules) -> pa.Table:
    """Matches of one group.  pings: id, ping_sec, latitude, longitude, direction (null: any); visits: trip_id, direction,
    stop_id, stop_sequence, sec, stop_lat, stop_lon.
    """
    if not pings.num_rows or not visits.num_rows:
        return _SCHEMA.empty_table()
    numbers = lambda table, c: table.column(c).to_numpy()
    trip_ids, trip = _ranked(visits.column("trip_id"))
    stop_ids, stop_id = _ranked(visits.column("stop_id"))
    places, stop = np.unique(np.column_stack([stop_id.astype(float), numbers(visits, "stop_lat"), numbers(visits, "stop_lon")]), axis=0, return_inverse=True)
    stop, seq, sec = stop.reshape(-1), numbers(visits, "stop_sequence").astype(np.int64), numbers(visits, "sec").astype(np.int64)
    v_way, p_way = visits.column("direction").to_pandas().to_numpy(float, na_value=np.nan), pings.column("direction").to_pandas().to_numpy(float, na_value=np.nan)
    ids, t, lat, lon = (numbers(pings, c) for c in ("id", "ping_sec", "latitude", "longitude"))
    out = []
    for way in np.unique(p_way):  # one NaN at most
        v, p = (slice(None), np.nonzero(np.isnan(p_way))[0]) if np.isnan(way) else (v_way == way, np.nonzero(p_way == way)[0])
        if not len(trip[v]):
            continue
        table = Timetable(trip[v], stop[v], seq[v], sec[v])
        for part in (p[i : i + CHUNK] for i in range(0, len(p), CHUNK)):
            dist = _distances(lat[part], lon[part], places[:, 1], places[:, 2])
            rows, held, conf = table.best(t[part], dist, rules)
            at = table.stop[held]
            out.append(pa.table([ids[part][rows], trip_ids[table.trip[held]], stop_ids[places[at, 0].astype(np.int64)], table.seq[held].astype(np.int32), t[part][rows] - table.sec[held], dist[rows, at], conf], schema=_SCHEMA))
    return pa.concat_tables(out) if out else _SCHEMA.empty_table()
