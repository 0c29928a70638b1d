"""Exact money arithmetic and number display, as SQL expressions.

Amounts are summed as whole millionths (``DECIMALS`` places), so a sum does not depend
on how rows were partitioned, and come back as DOUBLE. Places beyond are rounded away.
"""

DECIMALS = 6
LOW_BITS = 20


def exact_sum(amount: str, decimals: int = DECIMALS) -> str:
    """Sum of amounts of up to ``decimals`` places; null over no rows.

    The high and low bits of the scaled amounts are summed apart as BIGINT, which stays
    far from overflow over trillions of rows and costs a tenth of a DECIMAL sum. An
    amount times ``10**decimals`` must fit a BIGINT.
    """
    high, low = unit_sums(amount, decimals)
    return from_units(high, low, decimals)


def unit_sums(amount: str, decimals: int = DECIMALS) -> tuple[str, str]:
    """The two BIGINT sums behind ``exact_sum``; sums of several parts add up to those of the whole."""
    units = f"cast(rint(({amount}) * {10**decimals}D) as bigint)"
    return f"sum(shiftright({units}, {LOW_BITS}))", f"sum({units} & {2**LOW_BITS - 1})"


def from_units(high: str, low: str, decimals: int = DECIMALS) -> str:
    """The amount as DOUBLE of two sums by ``unit_sums``."""
    whole = f"cast({high} as decimal(19,0)) * cast({2**LOW_BITS} as decimal(7,0)) + cast({low} as decimal(19,0))"
    return f"cast({whole} as double) / {10**decimals}D"


def ratio(total: str, count: str) -> str:
    """total / count as DOUBLE; null when count is zero."""
    return f"try_divide(cast({total} as double), cast({count} as double))"


def _half_even(x: str, decimals: int) -> str:
    """``x`` rounded as its binary value is, exact halves to the even digit.

    Formatting itself would round the shortest decimal text, halves up. The fraction is
    taken as two whole numbers of 40 bits, which hold all bits of any double from 1e-8 on.
    """
    value, bits, scale = f"abs(cast({x} as double))", 2**40, 10**decimals
    fraction = f"({value} - floor({value}))"
    high = f"cast(floor({fraction} * {bits}D) as bigint)"
    low = f"cast(({fraction} * {bits}D - floor({fraction} * {bits}D)) * {bits}D as bigint) * {scale}L"
    scaled = f"({high} * {scale}L + shiftright({low}, 40))"
    digits, rest, last = f"shiftright({scaled}, 40)", f"({scaled} & {bits - 1}L)", f"({low} & {bits - 1}L)"
    half = f"{bits // 2}L"
    up = f"({rest} > {half} OR ({rest} = {half} AND ({last} > 0 OR {digits} % 2 = 1)))"
    units = f"cast(floor({value}) as double) * {scale}D + {digits} + if({up}, 1, 0)"
    return f"(if({x} < 0, -1D, 1D) * ({units}) / {scale}D)"


def as_dollars(x: str) -> str:
    return f"format_string('$%,.2f', {_half_even(x, 2)})"


def as_percent(x: str) -> str:
    return f"format_string('%.1f%%', {_half_even(x, 1)})"


def as_count(x: str) -> str:
    return f"format_string('%,d', cast({x} as bigint))"


def plain(x: str, decimals: int) -> str:
    """A double as plain decimal text: no exponent, at least one decimal kept."""
    text = f"cast(cast({x} as decimal(38,{decimals})) as string)"
    return f"regexp_replace({text}, '([.][0-9]+?)0+$', '$1')"
