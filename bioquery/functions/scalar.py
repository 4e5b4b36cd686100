"""Column functions of the signal domain; all run inside whole-stage code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def zigzag(x) -> Column:
    """Non-negative code of a signed integer: 0, -1, 1, -2 become 0, 1, 2, 3."""
    x = _c(x)
    return F.when(x >= 0, x * 2).otherwise(-x * 2 - 1)


def unzigzag(z) -> Column:
    z = _c(z)
    return F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1))


def floor_div(x, divisor: int) -> Column:
    """Integer division that rounds down, for long values of either sign."""
    x = _c(x)
    return ((x - F.pmod(x, F.lit(divisor).cast("long"))) / F.lit(divisor)).cast("long") if divisor & (divisor - 1) else F.shiftright(x, divisor.bit_length() - 1)


def quantize(x, step: int) -> Column:
    """Index of the nearest multiple of step; ties go away from zero."""
    x = _c(x)
    twice = F.abs(x) * 2 + step
    magnitude = ((twice - twice % (2 * step)) / (2 * step)).cast("long")
    return F.signum(x.cast("double")).cast("long") * magnitude


def strip_bits(x, bits: int) -> Column:
    return F.shiftright(_c(x), bits)


def restore_bits(x, bits: int) -> Column:
    return F.shiftleft(_c(x), bits)


def clamp16(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(-32768).cast("long")), F.lit(32767).cast("long"))


def golomb_k(mean) -> Column:
    """Rice parameter: how often the mean can be halved before it falls below 2; 31 at most."""
    mean = _c(mean)
    out = F.lit(0)
    for k in range(1, 32):
        out = F.when(mean >= float(2**k), k).otherwise(out)
    return out


def calibrate(x, phys_min, phys_max, dig_min, dig_max) -> Column:
    """Physical value by the linear map of digital to physical range; 0 where the digital range is empty."""
    span = _c(dig_max) - _c(dig_min)
    scale = F.when(span == 0, 0.0).otherwise((_c(phys_max) - _c(phys_min)) / F.when(span == 0, 1).otherwise(span))
    return F.when(span == 0, 0.0).otherwise(_c(x) * scale + (_c(phys_min) - _c(dig_min) * scale))


def auto_window(n, rate) -> Column:
    """Window length from the samples at 250 Hz: 2500 for long recordings, else all, within limits."""
    reference = F.ceil(_c(n) * 250.0 / _c(rate))
    return F.when(reference > 16384, 2500).otherwise(F.least(F.greatest(reference, F.lit(2500)), F.lit(65535))).cast("long")


#: Extensions that are stored as they are: fixed values.
STORED = ("lml", "lmq", "lma", "gz", "zst", "zip", "7z", "png", "jpg", "jpeg", "mp4", "avi")


def method_of(path) -> Column:
    """Archive method by extension: signals go to the codec, packed files are stored, the rest is compressed."""
    ext = F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1))
    return F.when(ext.isin("edf", "bdf"), "lml").when(ext.isin(*STORED), "store").otherwise("zstd")


def human_bytes(n) -> Column:
    """12 B, 3.4 KB, 5.6 MB ..."""
    n = _c(n)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < float(1024 ** (power + 1)), F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(n / float(1024**5), 1)), F.lit(" PB")))


def unsafe_path(path) -> Column:
    """Absolute paths, drive letters, backslashes, NUL, empty names and any '..' component."""
    path = _c(path)
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | path.contains("\0") | path.rlike("^[A-Za-z]:") | path.rlike(r"(^|/)\.\.(/|$)")


def byte_size(text) -> Column:
    """Bytes of a size such as 512, 10K, 3M or 2G (powers of 1024); null if it isn't one."""
    text = F.upper(F.trim(_c(text)))
    number = F.regexp_extract(text, r"^([0-9]+)([KMG]?)B?$", 1)
    unit = F.regexp_extract(text, r"^([0-9]+)([KMG]?)B?$", 2)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("long")
    return F.when(number != "", number.cast("long") * factor)


def stem(path) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def crc32(data) -> Column:
    return F.crc32(_c(data))


#: Classes of evidence nodes by tag, and which of them count as evidence: fixed values.
CLASSES = ("measured", "derived", "estimated", "generated", "hypothesis", "action", "outcome")
EVIDENCE = ("measured", "derived", "outcome")


def class_name(tag) -> Column:
    """Name of a class tag; null if it is unknown."""
    known = _c(tag).between(0, len(CLASSES) - 1)
    return F.when(known, F.element_at(F.array(*map(F.lit, CLASSES)), F.when(known, _c(tag).cast("int") + 1).otherwise(1)))


def is_evidence(tag) -> Column:
    """Whether a class counts as evidence; null (never credited) if it is unknown."""
    return class_name(tag).isin(*EVIDENCE)


#: Canonical electrode names and their aliases: fixed values.
ELECTRODES = ("Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6", "A1", "A2", "Fz", "Cz", "Pz")
ALIASES = {"T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6"}


def electrode(label) -> Column:
    """Canonical electrode of a channel label; the first of a bipolar pair; null if it isn't known."""
    name = F.upper(F.regexp_replace(F.trim(_c(label)), "(?i)^EEG +", ""))
    name = F.regexp_replace(F.regexp_replace(name, "-.*$", ""), "[. ]+$", "")
    known = {e.upper(): e for e in ELECTRODES} | ALIASES
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name)


def round_ratio(numerator, denominator) -> Column:
    """Nearest whole number of a ratio of longs, ties to the even one; the denominator must be positive."""
    n, d = _c(numerator).cast("long"), _c(denominator).cast("long")
    low = (n - F.pmod(n, d)) / d  # whole, so that the division is exact below 2**53
    low = low.cast("long")
    twice = F.pmod(n, d) * 2
    return low + F.when((twice > d) | ((twice == d) & (F.pmod(low, F.lit(2)) == 1)), 1).otherwise(0)


def q47_16(x, phys_min, phys_max, dig_min, dig_max) -> Column:
    """Physical value by the linear map in 1/65536 units, ties to even; all bounds are whole numbers; null for an empty digital range."""
    x, low, high, first, last = map(_c, (x, phys_min, phys_max, dig_min, dig_max))
    span = last - first
    scaled = ((x - first) * (high - low) + low * span) * 65536
    return F.when(span > 0, round_ratio(scaled, F.when(span > 0, span).otherwise(1)))


def q31_to_float(q) -> Column:
    """Single-precision value of a fixed-point sample, times 1000."""
    return (_c(q).cast("float") / F.lit(2147483647.0).cast("float")).cast("float") * F.lit(1000.0).cast("float")


def _let(value, f) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def decimal_ratio(text) -> Column:
    """Struct (num, den) in lowest terms that a decimal text of up to 18 digits equals; null if it isn't one.

    The common factor of the digits and a power of ten is one of a power of 2,
    their lowest common bit, and one of a power of 5, by counting.
    """
    long = lambda k: F.lit(k).cast("long")
    power = lambda k: F.element_at(F.array(*[long(5**j) for j in range(19)]), k + 1)
    div = lambda x, y: F.call_function("div", x, y)
    fields = lambda **c: F.struct(*[x.alias(name) for name, x in c.items()])

    def parts(t):
        ok = t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$") & (F.length(F.regexp_replace(t, "[+.-]", "")) <= 18)
        point = F.instr(t, ".")
        return F.when(ok, fields(n=F.regexp_replace(t, "[+.]", "").cast("long"), places=F.when(point > 0, F.length(t) - point).otherwise(0)))

    def lowest(p):
        twos = F.call_function("shiftleft", long(1), p["places"])
        both = p["n"].bitwiseOR(twos)
        times = F.lit(0)
        for k in range(1, 19):
            times = F.when((p["places"] >= k) & (p["n"] % long(5**k) == 0), k).otherwise(times)
        return fields(n=p["n"], twos=twos, places=p["places"], low=both.bitwiseAND(-both), times=times)

    def ratio(p):
        num, den = div(div(p["n"], p["low"]), power(p["times"])), div(p["twos"], p["low"]) * power(p["places"] - p["times"])
        return F.when(p["n"].isNotNull(), fields(num=num.cast("decimal(38,0)"), den=den.cast("decimal(38,0)")))

    return _let(_let(_let(F.trim(_c(text)), parts), lowest), ratio)


def float_ratio(x) -> Column:
    """Struct (num, den) that a single-precision number exactly equals, den a power of two; null if it isn't finite or den is over 2**60."""
    x = _c(x).cast("double")
    powers = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.pow(F.lit(2.0), k))
    den = F.element_at(F.filter(powers, lambda p: x * p == F.rint(x * p)), 1)
    finite = ~F.isnan(x) & (F.abs(x) < float(1 << 62))
    return F.when(finite & den.isNotNull(), F.struct((x * den).cast("long").alias("num"), den.cast("long").alias("den")))


def template(pattern: str, path) -> Column:
    """A path from a pattern with {stem}, {name}, {dir} and {ext} of another path."""
    path = _c(path)
    parts = {"stem": stem(path), "name": F.regexp_extract(path, r"([^/]*)$", 1), "dir": F.regexp_replace(path, r"/?[^/]*$", ""), "ext": F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)}
    out = F.lit(pattern)
    for name, value in parts.items():
        if "{" + name + "}" in pattern:
            out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def first_field(json, keys) -> Column:
    """The first of several fields of a JSON text that is there."""
    return F.coalesce(*[F.get_json_object(_c(json), f"$.{k}") for k in keys])
