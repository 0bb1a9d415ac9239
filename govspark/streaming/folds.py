"""The step functions of the keyed streaming operators: one event and a small state in, a tag out.

Each takes the key's state as a plain dict and is shared by the stream and its tests.
"""

from __future__ import annotations

SECOND_US = 1_000_000
HOUR_US, DAY_US = 3_600 * SECOND_US, 86_400 * SECOND_US


def budget_step(state: dict, ts_us: int, cost: int, daily: int, hourly: int) -> str:
    """Admit unless the day's or the hour's admitted cost is at its limit; sums restart with UTC day and hour."""
    day, hour = ts_us // DAY_US, ts_us // HOUR_US
    if state.get("day") != day:
        state["day"], state["day_cost"] = day, 0
    if state.get("hour") != hour:
        state["hour"], state["hour_cost"] = hour, 0
    if daily > 0 and state["day_cost"] >= daily:
        return "daily_exceeded"
    if hourly > 0 and state["hour_cost"] >= hourly:
        return "hourly_exceeded"
    state["day_cost"] += cost
    state["hour_cost"] += cost
    return "admitted"


def lockout_step(state: dict, ts_us: int, success: bool, attempts: int, window_us: int,
                 base_us: int, max_us: int) -> str:
    """Failures within the window lock the key, each further lockout twice as long; success forgets everything."""
    if state.get("until", 0) > ts_us:
        return "blocked"
    if success:
        state.clear()
        return "success"
    recent = [t for t in state.get("recent", []) if ts_us - t <= window_us] + [ts_us]
    if len(recent) >= attempts:
        rounds = state.get("rounds", 0)
        state.update(until=ts_us + min(base_us * 2 ** min(rounds, 31), max_us), rounds=rounds + 1, recent=[])
        return "locked_out"
    state["recent"] = recent
    return "failure"


def alert_step(state: dict, window_us: int, value: float, threshold: float, cooldown_us: int) -> str | None:
    """Fire on reaching the threshold, resolve below it; within the cooldown after a firing do neither."""
    if "fired" in state and window_us - state["fired"] < cooldown_us:
        return None
    active = state.get("active", False)
    if value >= threshold:
        if active:
            return None
        state.update(active=True, fired=window_us)
        return "fired"
    state["active"] = False
    return "resolved" if active else None


def anomaly_step(state: dict, ts_us: int, tables: list[str], fingerprint: int, after: int,
                 window_us: int, history: int, z: float) -> list[str]:
    """Anomalies of one query against the user's profile, which then learns the query."""
    hour, window = ts_us // HOUR_US % 24, ts_us - ts_us % window_us
    past, found = state.setdefault("history", []), []
    if state.get("window") != window:
        if "window" in state:
            past.append(state["count"])
            del past[:-history]
        state.update(window=window, count=0)
    if state.setdefault("queries", 0) >= after:
        found += [f"NEW_TABLE:{t}" for t in tables if t not in state["tables"]]
        if fingerprint and fingerprint not in state["patterns"]:
            found.append("NEW_QUERY_PATTERN")
        if hour not in state["hours"]:
            found.append(f"UNUSUAL_HOUR:{hour}")
    if len(past) >= 2:
        # More than z deviations above the mean, compared as whole numbers.
        over = len(past) * state["count"] - sum(past)
        spread = len(past) * sum(c * c for c in past) - sum(past) ** 2
        if spread > 0 and over > 0 and over * over > z * z * spread:
            found.append("VOLUME_SPIKE")
    state["queries"] += 1
    state["count"] += 1
    state.setdefault("tables", set()).update(tables)
    state.setdefault("hours", set()).add(hour)
    patterns = state.setdefault("patterns", set())
    if fingerprint:
        patterns.add(fingerprint)
    return found
