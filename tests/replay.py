"""Plain Python statements of the rules, to test the joins and aggregates against."""

from __future__ import annotations

import datetime


def same(a, b):
    """Dates are (precision, year, month or None, day or None) or None."""
    if a is None or b is None:
        return a is b
    if a[0] == b[0]:
        depth = 1 if a[0] <= 9 else 2 if a[0] == 10 else 3
        return a[1:1 + depth] == b[1:1 + depth]
    coarse, fine = sorted((a, b), key=lambda d: d[0])
    p, y = coarse[0], coarse[1]
    if p == 6:
        low = (y - 1) // 1000 * 1000 + 1
        return low <= fine[1] <= low + 999
    if p == 7:
        return y <= fine[1] <= y + 99
    if p == 8:
        return y // 10 == fine[1] // 10
    if p in (9, 10, 11):
        return coarse[1:p - 7] == fine[1:p - 7]
    return False


def finer(a, b):
    return a is not None and (b is None or a[0] > b[0])


def accepted_term(c, k):
    """Known term ``k`` equals candidate ``c`` or is more precise."""
    if c == (None, None):
        return True
    if k == (None, None):
        return False
    if not (same(c[0], k[0]) and same(c[1], k[1])):
        return False
    mine = finer(c[0], k[0]) or finer(c[1], k[1])
    theirs = finer(k[0], c[0]) or finer(k[1], c[1])
    return theirs or not mine


def adjoin(e, s):
    if e[0] != s[0] or e[0] not in (9, 10, 11):
        return False
    if e[0] == 9:
        return 0 <= s[1] - e[1] <= 1
    if e[0] == 10:
        return bool(e[2] and s[2]) and 0 <= (s[1] - e[1]) * 12 + s[2] - e[2] <= 1
    if not (e[2] and e[3] and s[2] and s[3]):
        return False
    try:
        return 0 <= (datetime.date(*s[1:]) - datetime.date(*e[1:])).days <= 1
    except ValueError:
        return False


def order(t):
    s, e = t
    return (s[1], s[2] or 0, s[3] or 0, s[0], -1 if e is None else e[0],
            (-1,) if e is None else (e[1], e[2] or 0, e[3] or 0))


def told(c, terms):
    """Consecutive known terms span the candidate."""
    if c[0] is None or len(terms) < 2:
        return False
    dated = sorted((t for t in terms if t[0] is not None), key=order)
    for i, (s, e) in enumerate(dated):
        if not same(c[0], s) or finer(c[0], s):
            continue
        end = e
        for s2, e2 in dated[i + 1:]:
            if end is None or not adjoin(end, s2):
                break
            end = e2
        if c[1] is None and end is None:
            return True
        if c[1] is not None and end is not None and same(c[1], end) and not finer(c[1], end):
            return True
    return False


def text(d):
    if d is None:
        return None
    return "-".join(f"{n:0{4 if i == 0 else 2}d}" for i, n in enumerate(d[1:d[0] - 7]))


def time(d):
    return None if d is None else f"+{d[1]:04d}-{d[2] or 0:02d}-{d[3] or 0:02d}T00:00:00Z"
