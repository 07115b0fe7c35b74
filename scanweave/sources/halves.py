"""Numbers to half precision, for arrays; functions.pixels.half_bits is the same for columns."""

from __future__ import annotations

import numpy as np

INFINITE, NOT_A_NUMBER = 0x7C00, 0x7E00


def half_bits(v: np.ndarray, compat: bool = False, nan: int = NOT_A_NUMBER) -> np.ndarray:
    """The 16 bits of IEEE binary16 nearest to each number; ties go to the even one.

    compat: ties go up, and a mantissa that is rounded up to the next power of
    two is laid over the exponent's bits instead of being added to them, so it
    is lost where the exponent is odd; nan is what a NaN becomes.
    """
    with np.errstate(over="ignore"):
        if not compat:
            return np.asarray(v).astype(np.float16).view(np.uint16)
        bits = np.asarray(v).astype(np.float32).view(np.uint32).astype(np.int64)
    sign, exponent = bits >> 16 & 0x8000, (bits >> 23 & 0xFF) - 112
    mantissa = bits & 0x7FFFFF
    # below 2**-14 the leading one is part of the mantissa, which is shifted out
    shift = np.clip(14 - exponent, 1, 25)
    small = ((mantissa | 0x800000) + (1 << shift - 1)) >> shift
    normal = np.maximum(exponent, 0) << 10 | mantissa + 0x1000 >> 13
    out = np.where(exponent > 0, normal, small)
    out = np.where(exponent >= 31, INFINITE, out)
    out = np.where((exponent == 143) & (mantissa > 0), nan, sign | out)
    return out.astype(np.uint16)
