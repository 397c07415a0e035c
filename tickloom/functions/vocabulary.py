"""The factor vocabulary: 65 features and 62 operators by token."""

from __future__ import annotations

import hashlib

from tickloom.functions.series import Program, X, call, clip, finite, sdiv, sign, when

O, H, L, C, V = (X(n) for n in ("open", "high", "low", "close", "volume"))
TYPICAL = (H + L + C) / 3


def _bollinger(p: Program) -> tuple[X, X, X]:
    mid, s = p.let(p.mean0(C, 20)), p.std0(C, 20)
    return p.let(mid - 2 * s), p.let(mid + 2 * s), mid


def _true_range(p: Program) -> X:
    before = p.previous(C)
    return p.let(call("greatest", H - L, call("abs", H - before), call("abs", L - before)))


def _atr(p: Program) -> X:
    return p.mean0(_true_range(p), 14)


def _off_mean(p: Program, x: X, n: int) -> X:
    m = p.let(p.mean0(x, n))
    return sdiv(x - m, m)


def _ratio_to(p: Program, k: int) -> X:
    return p.let(sdiv(C, p.lag0(C, k)))


def _rsi(p: Program) -> X:
    d = p.diff(C)
    rs = p.let(sdiv(p.mean0(call("greatest", d, 0), 14), p.mean0(call("greatest", -d, 0), 14)))
    return when(X(f"({d} = 0e0)"), 0, (100 - X(f"(100e0 / {1 + rs})")) / 100)


def _vwap(p: Program) -> X:
    v = p.let(sdiv(p.sum0(TYPICAL * V, 20), p.sum0(V, 20)))
    return sdiv(C - v, v)


def _money_flow(p: Program) -> X:
    before, flow = p.previous(TYPICAL), TYPICAL * V
    now = p.let(TYPICAL)
    up, down = p.sum0(when(now > before, flow, 0), 14), p.sum0(when(now < before, flow, 0), 14)
    return X(f"(100e0 - 100e0 / {1 + p.let(sdiv(up, down))})") / 50 - 1


def _position(p: Program, high: X, low: X, n: int) -> tuple[X, X]:
    return p.let(p.max0(high, n)), p.let(p.min0(low, n))


def _williams(p: Program) -> X:
    hi, lo = _position(p, H, L, 14)
    return clip(sdiv(hi - C, hi - lo), 0, 1) * 2 - 1


def _cci(p: Program) -> X:
    t = p.let(TYPICAL)
    m = p.let(p.mean0(t, 14))
    return clip(sdiv(t - m, 0.015 * p.mean0(call("abs", t - m), 14) + 1e-9) / 200, -1, 1)


def _macd(p: Program) -> X:
    line = p.let(p.ema(C, 12) - p.ema(C, 26))
    return sdiv(line - p.ema(line, 9), C)


def _trix(p: Program) -> X:
    e = p.ema(p.ema(p.ema(C, 15), 15), 15)
    return p.let(sdiv(e - p.lag0(e, 1), call("abs", e) + 1e-9))


def _ultimate(p: Program) -> X:
    before = p.previous(C)
    low, high = call("least", L, before), call("greatest", H, before)
    part = lambda n: sdiv(p.sum0(C - low, n), p.sum0(high - low, n))
    return clip((4 * part(7) + 2 * part(14) + part(28)) / 7 * 2 - 1, -1, 1)


def _directional(p: Program) -> tuple[X, X]:
    up, down = p.diff(H), p.let(-p.diff(L))
    atr = p.let(p.mean0(_true_range(p), 14) + 1e-9)
    plus = p.let(100 * sdiv(p.mean0(when((up > down) & (up > 0), up, 0), 14), atr))
    minus = p.let(100 * sdiv(p.mean0(when((down > up) & (down > 0), down, 0), 14), atr))
    return 100 * sdiv(call("abs", plus - minus), plus + minus + 1e-9), plus - minus


def _stochastic(p: Program) -> X:
    hi, lo = _position(p, H, L, 14)
    return p.let(sdiv(C - lo, hi - lo) * 2 - 1)


def _middle(p: Program, n: int) -> X:
    hi, lo = _position(p, H, L, n)
    return sdiv(C - (hi + lo) / 2, hi - lo + 1e-9)


def _ret(p: Program) -> X:
    return p.returns(C)


def _auto(p: Program, k: int, n: int) -> X:
    return p.corr0(_ret(p), p.lag0(_ret(p), k), n, 1e-9)


def _channel(p: Program) -> X:
    m, a = p.let(p.mean0(C, 20)), p.let(_atr(p))
    return when(C >= m + 2 * a, 1, when(C <= m - 2 * a, -1, 0))


def _squared(x: X) -> X:
    return X(f"({x} * {x})")


def _above(p: Program, x: X, y: X) -> X:
    return X(p.d.log_ratio(str(x), str(y)))


def _price_place(p: Program) -> X:
    hi, lo = _position(p, C, C, 50)
    return sdiv(C - lo, hi - lo)


def _donchian(p: Program) -> X:
    hi, lo = _position(p, H, L, 20)
    return sdiv(C - lo, hi - lo)


LN2 = 0.6931471805599453
#: Names in token order; each with its category, lookback and meaning.
FEATURES = {
    "RET": ("trend", 2, _ret),
    "RET5": ("trend", 5, lambda p: _ratio_to(p, 5)),
    "RET20": ("trend", 20, lambda p: _ratio_to(p, 20)),
    "MA_DIFF": ("trend", 20, lambda p: _off_mean(p, C, 20)),
    "SLOPE20": ("trend", 20, lambda p: p.slope(C, 20)),
    "ATR": ("volatility", 14, lambda p: sdiv(_atr(p), C)),
    "RVOL": ("volatility", 20, lambda p: p.std0(_ret(p), 20)),
    "HL_RANGE": ("volatility", 1, lambda p: sdiv(H - L, C)),
    "VOL_REGIME": ("volatility", 60, lambda p: sdiv(p.std0(_ret(p), 20), p.mean0(p.std0(_ret(p), 20), 60) + 1e-9)),
    "DEV": ("reversal", 20, lambda p: _off_mean(p, C, 20)),
    "DEV60": ("reversal", 60, lambda p: _off_mean(p, C, 60)),
    "RSI14": ("reversal", 14, _rsi),
    "PRESSURE": ("reversal", 1, lambda p: sdiv(2 * C - H - L, H - L)),
    "AC1": ("reversal", 20, lambda p: _auto(p, 1, 20)),
    "VOL_RATIO": ("volume", 20, lambda p: sdiv(V, p.mean0(V, 20)) - 1),
    "VOL_Z": ("volume", 20, lambda p: sdiv(V - p.mean0(V, 20), p.std0(V, 20))),
    "PV_CORR": ("volume", 20, lambda p: p.corr0(_ret(p), p.returns(V), 20, 1e-9)),
    "REL_RET5": ("cross_sectional", 5, lambda p: p.cross_demean(_ratio_to(p, 5) - 1)),
    "REL_RET20": ("cross_sectional", 20, lambda p: p.cross_demean(_ratio_to(p, 20) - 1)),
    "REL_VOL": ("cross_sectional", 20, lambda p: p.cross_demean(p.std0(_ret(p), 20))),
    "VWAP_DEV": ("volume", 20, _vwap),
    "BOLL_POS": ("channel", 20, lambda p: (lambda b: clip(sdiv(C - b[0], b[1] - b[0]), 0, 1) * 2 - 1)(_bollinger(p))),
    "BOLL_WIDTH": ("volatility", 20, lambda p: (lambda b: sdiv(b[1] - b[0], call("abs", b[2]) + 1e-9))(_bollinger(p))),
    "MACD_HIST": ("momentum", 35, _macd),
    "OBV_SLOPE": ("volume", 20, lambda p: p.slope(p.running(sign(p.diff(C)) * V), 20)),
    "MFI14": ("volume", 14, _money_flow),
    "WILLR_14": ("reversal", 14, _williams),
    "CCI_14": ("reversal", 14, _cci),
    "ROC_12": ("momentum", 12, lambda p: _ratio_to(p, 12) - 1),
    "TYPICAL_DEV": ("reversal", 20, lambda p: _off_mean(p, p.let(TYPICAL), 20)),
    "EMA_RATIO_12_26": ("trend", 26, lambda p: sdiv(p.ema(C, 12), p.ema(C, 26)) - 1),
    "TREND_STRENGTH_50": ("trend", 50, lambda p: p.slope(C, 50)),
    "PRICE_POS_50": ("trend", 50, _price_place),
    "TRIX_15": ("momentum", 15, _trix),
    "PPO": ("momentum", 26, lambda p: sdiv(p.ema(C, 12) - p.ema(C, 26), p.ema(C, 26))),
    "ULT_OSC": ("momentum", 28, _ultimate),
    "RET_ACCEL": ("momentum", 2, lambda p: p.diff(_ret(p))),
    "GK_VOL": ("volatility", 2, lambda p: call("sqrt", call("greatest", 0.5 * _squared(_above(p, H, L)) - (2 * LN2 - 1) * _squared(_ret(p)), 0))),
    "PARKINSON_VOL": ("volatility", 2, lambda p: call("sqrt", _squared(_above(p, H, L)) / (4 * LN2))),
    "YANG_ZHANG_VOL": ("volatility", 20, lambda p: call("sqrt", _squared(p.std0(_ret(p), 20)) + _squared(p.std0(_above(p, O, p.previous(C, O)), 20)))),
    "RS_VOL": ("volatility", 20, lambda p: call("sqrt", call("greatest", p.mean0(_above(p, H, C) * _above(p, H, O) + _above(p, L, C) * _above(p, L, O), 20), 0))),
    "AMIHUD_ILLIQ": ("volume", 2, lambda p: sdiv(call("abs", _ret(p)), call("greatest", V * C, 1e-9))),
    "KYLE_LAMBDA": ("volume", 2, lambda p: sdiv(_ret(p), call("greatest", V, 1e-9))),
    "CMF_20": ("volume", 20, lambda p: sdiv(p.sum0(((C - L) - (H - C)) / (H - L + 1e-9) * V, 20), p.sum0(V, 20))),
    "AD_LINE_SLOPE": ("volume", 20, lambda p: p.slope(p.running(sdiv(2 * C - H - L, H - L) * V), 20)),
    "STOCH_K_14": ("reversal", 14, _stochastic),
    "STOCH_D_3": ("reversal", 14, lambda p: p.mean0(_stochastic(p), 3)),
    "AROON_OSC_25": ("reversal", 25, lambda p: (p.first_at(H, 25, True) - p.first_at(L, 25, False)) / 24),
    "DMI_ADX_14": ("trend", 14, lambda p: _directional(p)[0] / 100),
    "DMI_DIFF_14": ("trend", 14, lambda p: _directional(p)[1] / 100),
    "TRIX_SIGNAL": ("momentum", 15, lambda p: p.mean0(_trix(p), 9)),
    "DONCHIAN_POS_20": ("channel", 20, _donchian),
    "KELTNER_POS_20": ("channel", 20, lambda p: sdiv(C - (p.mean0(C, 20) + 2 * _atr(p)), 4 * _atr(p) + 1e-9)),
    "ICHIMOKU_KIJUN_DEV": ("channel", 26, lambda p: _middle(p, 26)),
    "ICHIMOKU_TENKAN_DEV": ("channel", 9, lambda p: _middle(p, 9)),
    "SUPERTREND_DIR": ("channel", 20, _channel),
    "SAR_DIST": ("channel", 20, lambda p: _middle(p, 20)),
    "ROLL_SKEW_20": ("statistical", 20, lambda p: p.standard_moment(_ret(p), 20, 3)),
    "ROLL_KURT_20": ("statistical", 20, lambda p: p.standard_moment(_ret(p), 20, 4) - 3),
    "HURST_50": ("statistical", 50, lambda p: clip(0.5 + 0.5 * _auto(p, 5, 50), 0, 1)),
    "FRACTAL_DIM_30": ("statistical", 30, lambda p: 2 - call("abs", p.slope(call("ln", call("greatest", C, 1e-9)), 30))),
    "AC2": ("statistical", 20, lambda p: _auto(p, 2, 20)),
    "RET_ENTROPY_20": ("statistical", 20, lambda p: p.entropy(_ret(p), 20)),
    "CS_RANK_RET5": ("cross_sectional", 5, lambda p: p.cross_rank(_ratio_to(p, 5) - 1)),
    "CS_ZSCORE_RET20": ("cross_sectional", 20, lambda p: p.cross_demean(_ratio_to(p, 20) - 1)),
}
EPS = 1e-6


def _weighted(p: Program, x: X, weights: list[float], total: float) -> X:
    """Weights from the oldest to the newest value of the window."""
    n, out = len(weights), None
    for k, w in enumerate(reversed(weights)):
        term = w * (p.lag0(x, k) if k else x)
        out = term if out is None else out + term
    return out / total


def _z(p: Program, x: X, n: int) -> X:
    return sdiv(x - p.mean0(x, n), p.std0(x, n), EPS)


#: Names in token order behind the features; each with its number of arguments and meaning.
OPERATORS = {
    "ADD": (2, lambda p, x, y: x + y),
    "SUB": (2, lambda p, x, y: x - y),
    "MUL": (2, lambda p, x, y: x * y),
    "DIV": (2, lambda p, x, y: sdiv(x, y, EPS)),
    "NEG": (1, lambda p, x: -x),
    "ABS": (1, lambda p, x: call("abs", x)),
    "SIGN": (1, lambda p, x: sign(x)),
    "GATE": (3, lambda p, c, x, y: when(c > 0, x, y)),
    "JUMP": (1, lambda p, x: call("tanh", x - p.lag0(x, 1))),
    "DECAY": (1, lambda p, x: 0.5 * x + 0.5 * p.lag0(x, 1)),
    "DELAY1": (1, lambda p, x: p.lag0(x, 1)),
    "MAX3": (1, lambda p, x: call("greatest", x, p.lag0(x, 1), p.lag0(x, 2))),
    "TS_MEAN_5": (1, lambda p, x: p.mean0(x, 5)),
    "TS_MEAN_10": (1, lambda p, x: p.mean0(x, 10)),
    "TS_MEAN_20": (1, lambda p, x: p.mean0(x, 20)),
    "TS_STD_5": (1, lambda p, x: p.std0(x, 5)),
    "TS_STD_10": (1, lambda p, x: p.std0(x, 10)),
    "TS_STD_20": (1, lambda p, x: p.std0(x, 20)),
    "TS_RANK_5": (1, lambda p, x: _share(p, x, 5)),
    "TS_RANK_10": (1, lambda p, x: _share(p, x, 10)),
    "TS_RANK_20": (1, lambda p, x: _share(p, x, 20)),
    "TS_CORR_10": (2, lambda p, x, y: p.corr0(x, y, 10, EPS)),
    "MOMENTUM_5": (1, lambda p, x: p.mean0(x, 5) - p.mean0(x, 20)),
    "MOMENTUM_10": (1, lambda p, x: p.mean0(x, 10) - p.mean0(x, 20)),
    "TS_MAX_10": (1, lambda p, x: p.max0(x, 10)),
    "TS_MIN_10": (1, lambda p, x: p.min0(x, 10)),
    "WMA": (1, lambda p, x: _weighted(p, x, [1.0, 2.0, 3.0, 4.0], 10.0)),
    "DELAY4": (1, lambda p, x: p.lag0(x, 4)),
    "EMA_5": (1, lambda p, x: p.ema(x, 5)),
    "EMA_20": (1, lambda p, x: p.ema(x, 20)),
    "TS_QUANTILE_10": (1, lambda p, x: p.quantile(x, 10, 0.5)),
    "TS_SKEW_10": (1, lambda p, x: p.standard_moment(x, 10, 3)),
    "TS_MIN_20": (1, lambda p, x: p.min0(x, 20)),
    "TS_MAX_20": (1, lambda p, x: p.max0(x, 20)),
    "DELTA": (1, lambda p, x: x - p.lag0(x, 1)),
    "TS_ARG_MAX_5": (1, lambda p, x: p.first_at(x, 5, True) / 4),
    "TS_ARG_MIN_5": (1, lambda p, x: p.first_at(x, 5, False) / 4),
    "DECAY_LINEAR_5": (1, lambda p, x: _weighted(p, x, [1.0, 2.0, 3.0, 4.0, 5.0], 15.0)),
    "SCALE": (1, lambda p, x: sdiv(x, p.whole(call("abs", x)) + 1e-9, EPS)),
    "COVARIANCE_10": (2, lambda p, x, y: p.mean0(x * y, 10) - p.mean0(x, 10) * p.mean0(y, 10)),
    "PRODUCT_5": (1, lambda p, x: p.let(p.d.fold_product(str(p.padded(x, 5))))),
    "SIGNED_POWER_2": (1, lambda p, x: x * call("abs", x)),
    "TS_DECAY_EXP_5": (1, lambda p, x: _weighted(p, x, [0.5**i for i in range(5)], sum(0.5**i for i in range(5)) + 1e-9)),
    "DELTA_5": (1, lambda p, x: x - p.lag0(x, 5)),
    "CS_RANK": (1, lambda p, x: p.cross_rank(x)),
    "CS_SCALE": (1, lambda p, x: p.cross_scale(x, EPS)),
    "CS_NEUTRALIZE": (1, lambda p, x: p.cross_demean(x)),
    "TS_SUM_5": (1, lambda p, x: p.sum0(x, 5)),
    "TS_SUM_10": (1, lambda p, x: p.sum0(x, 10)),
    "TS_SUM_20": (1, lambda p, x: p.sum0(x, 20)),
    "MIN": (2, lambda p, x, y: call("least", x, y)),
    "MAX": (2, lambda p, x, y: call("greatest", x, y)),
    "POWER": (1, lambda p, x: x * call("abs", x)),
    "SIGNED_LOG": (1, lambda p, x: sign(x) * call("ln", 1 + call("abs", x))),
    "SQRT": (1, lambda p, x: sign(x) * call("sqrt", call("abs", x))),
    "TS_ZSCORE_10": (1, lambda p, x: _z(p, x, 10)),
    "TS_ZSCORE_20": (1, lambda p, x: _z(p, x, 20)),
    "WINSORIZE": (1, lambda p, x: call("least", call("greatest", x, p.quantile(x, 20, 0.05)), p.quantile(x, 20, 0.95))),
    "CLIP": (1, lambda p, x: clip(x, -3, 3)),
    "SIGMOID": (1, lambda p, x: X(f"(2e0 / {1 + call('exp', -clip(x, -60, 60))})") - 1),
    "TANH_SQUASH": (1, lambda p, x: call("tanh", x)),
    "IF_GT": (3, lambda p, c, x, y: when(c > 0, x, y)),
}
#: Results that depend on rows still to come: refused on streams.
NOT_CAUSAL = {"SCALE"}
#: Results that depend on every earlier row: no lookback is enough for them.
UNBOUNDED = {"MACD_HIST", "OBV_SLOPE", "EMA_RATIO_12_26", "TRIX_15", "PPO", "AD_LINE_SLOPE", "TRIX_SIGNAL", "EMA_5", "EMA_20", "SCALE"}


def _share(p: Program, x: X, n: int) -> X:
    x = p.let(x)
    return p.let(f"{p.d.count_if(str(p.padded(x, n)), f'v <= {x}')} / {n}e0")


def names() -> list[str]:
    return [*FEATURES, *OPERATORS]


def version() -> str:
    """Changes with every name of the vocabulary and their order."""
    return "v" + hashlib.sha256("\x1f".join(names()).encode()).hexdigest()[:12]
