"""Declared schemas of the files the engine reads and writes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_L, _D, _S, _B, _I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()

# Observation stream as delivered: clock and flags may arrive as text.
RAW_STREAM = _schema(
    SCLK=_S, PRESSURE=_D, sol=_L, time=_S, gt_fwhm=_S, gt_vortex_ind=_I, gt_detection_win=_S, gt_4xfwhm=_S, PRESSURE_MA_500=_D
)
CATALOGUE = _schema(
    SOL=_I, HR=_I, MN=_I, SEC=_D, e_SEC=_D, PRES=_D, e_PRES=_D, DUR=_D, e_DUR=_D, RDS=_D, e_RDS=_D, meda_format_time=_S, SCLK=_L
)
EVENTS = _schema(
    event_id=_L, peak_sclk=_L, peak_idx=_L, detection_start=_L, detection_end=_L, fwhm_start=_L, fwhm_end=_L,
    fourxfwhm_start=_L, fourxfwhm_end=_L, time_hours=_D,
)
RUN_RECORD = _schema(run_id=_S, run_ts=_L, kind=_S, name=_S, threshold=_D, metric=_S, value=_D)
