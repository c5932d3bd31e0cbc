"""Small input frames with planted incidents, made by rules on the row number."""

from __future__ import annotations

import pandas as pd


def _share(row: int, salt: int) -> float:
    """An even spread over 0..1 that looks unordered."""
    return (row * 7919 + salt * 104729 + (row % 97) * (salt + 3) * 613) % 10007 / 10007


def _pick(row: int, salt: int, choices: list[str]) -> str:
    return choices[int(_share(row, salt) * len(choices))]


def _wobble(row: int, salt: int, size: float) -> float:
    return size * (_share(row, salt) + _share(row, salt + 1) + _share(row, salt + 2) - 1.5)


def daily_step() -> pd.DataFrame:
    """One reading a day that falls to a third after four weeks."""
    rows = [(i, 61.0 + _wobble(i, 5, 3.0) if i < 28 else 19.0 + _wobble(i, 6, 3.0)) for i in range(35)]
    days = pd.date_range("2023-02-01", periods=35).date
    return pd.DataFrame({"row_id": range(35), "date": days, "yield_rate": [v for _, v in rows]})


def outliers() -> pd.DataFrame:
    """Two related readings; the last three rows lie far off in both."""
    usual = [(8.0 + _wobble(i, 1, 2.0), 31.0 + _wobble(i, 4, 4.0)) for i in range(240)]
    odd = [(1.5, 96.0), (0.9, 120.0), (2.2, 141.0)]
    return pd.DataFrame([(i, *r) for i, r in enumerate([*usual, *odd])], columns=["row_id", "metric", "delay"])


def rate_drop() -> pd.DataFrame:
    """Two pumps with equal volumes; one loses three quarters of its rate."""
    rows = [(i, "north" if i % 2 else "south", 0.08 if i < 150 or i % 2 == 0 else 0.02) for i in range(300)]
    return pd.DataFrame(rows, columns=["row_id", "pump", "rate"])


def parcels(rows: int = 3600) -> pd.DataFrame:
    """Parcels that arrive on time or not; from 2023-03-11 one carrier fails in one region."""
    made = []
    for i in range(rows):
        day = i * 20 // rows
        carrier = _pick(i, 11, ["Kite", "Kite", "Otter", "Heron"])
        region = _pick(i, 23, ["coast", "coast", "hills", "plain"])
        shift = _pick(i, 37, ["early", "late"])
        broken = day >= 10 and carrier == "Kite" and region == "coast"
        scan = 40 + _wobble(i, 41, 9.0) + (60 + _wobble(i, 47, 20.0) if broken else 0)
        on_time = int(_share(i, 53) < (0.15 if broken else 0.75))
        made.append((
            f"P-{i:06d}-{(i * 31) % 997}", str((pd.Timestamp("2023-03-01") + pd.Timedelta(days=day)).date()), carrier, region,
            shift, round(scan, 1), 1 + i % 4, on_time, round(on_time * (4 + _wobble(i, 59, 2.0)), 2),
        ))
    names = ["parcel_key", "date", "carrier", "region", "shift", "scan_latency", "item_count", "on_time", "fee_amount"]
    return pd.DataFrame(made, columns=names)


def turbines(rows: int = 3000) -> pd.DataFrame:
    """Hourly checks of turbines; the newest model starts to stall on 2023-08-09."""
    made = []
    for i in range(rows):
        day = i * 16 // rows
        model, site = _pick(i, 3, ["A1", "B2", "C3"]), _pick(i, 17, ["ridge", "shore"])
        broken = day >= 8 and model == "C3"
        heat = 55 + _wobble(i, 29, 6.0) + (25 if broken else 0)
        stalled = int(_share(i, 71) < (0.35 if broken else 0.05))
        made.append((i, str((pd.Timestamp("2023-08-01") + pd.Timedelta(days=day)).date()), model, site, round(heat, 2), stalled))
    return pd.DataFrame(made, columns=["row_id", "date", "model", "site", "heat", "stalled"])
