"""Plain-Python counterparts of operators, for checks by brute force."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

ABBR = dict(Z=0, UTC=0, GMT=0, CET=60, CEST=120, EST=-300, EDT=-240, PST=-480, PDT=-420, JST=540)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LOW, HIGH = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds() * 1000) for y in (2020, 2031))


def _zone_shift(z):
    if z.upper() in ABBR:
        return ABBR[z.upper()]
    digits = z[1:].replace(":", "").ljust(4, "0")
    return (-1 if z[0] == "-" else 1) * (int(digits[:2]) * 60 + int(digits[2:]))


def moment(text, zone="UTC", order="dmy"):
    """Epoch ms of ``text`` or None; parses with strptime, unlike the operator."""
    if text is None or not text.strip():
        return None
    s = re.sub(r"\s+", " ", text.strip())

    def kept(ms):
        return ms if LOW <= ms < HIGH else None

    if re.fullmatch(r"\d+", s):
        n = int(s)
        for by in (1000, 1):
            if LOW <= n * by < HIGH:
                return n * by
        for by in (1000, 1_000_000):
            if LOW <= n // by < HIGH:
                return n // by
        return None
    if re.fullmatch(r"\d+\.\d+", s):
        whole, frac = s.split(".")
        return kept(int(whole) * 1000 + int(frac[:3].ljust(3, "0")))
    shift = None
    s = re.sub(r"\[[^]]*\]$", "", s)
    if m := re.search(r"(?<=[\d ])(Z|UTC|GMT|CES?T|E[SD]T|P[SD]T|JST)$", s):
        shift, s = _zone_shift(m[1]), s[: m.start()].strip()
    elif m := re.search(r"(?<=:\d\d)(\.\d+)? ?([+-]\d\d(:?\d\d)?)$", s):
        shift, s = _zone_shift(m[2]), s[: m.start(2)].strip()
    frac = "0"
    if m := re.search(r"(?<=:\d\d)[.,](\d+)$", s):
        frac, s = m[1], s[: m.start()]
    slash = "%m/%d/%Y" if order == "mdy" else "%d/%m/%Y"
    forms = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", slash + " %H:%M:%S", slash + ", %I:%M:%S %p", "%d.%m.%Y %H:%M:%S", "%d/%b/%Y:%H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%a %b %d %H:%M:%S %Y"]
    for f in forms:
        try:
            wall = datetime.strptime(s, f)
            break
        except ValueError:
            continue
    else:
        return None
    if shift is None:
        utc = wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    else:
        utc = wall.replace(tzinfo=timezone.utc) - timedelta(minutes=shift)
    return kept((utc - EPOCH) // timedelta(milliseconds=1) + int(frac[:3].ljust(3, "0")))
