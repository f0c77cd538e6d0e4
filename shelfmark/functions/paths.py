"""Path, name and label functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media kind by lower-case extension.
MEDIA_KINDS = {
    "photo": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "heic", "raw"],
    "video": ["mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v"],
    "music": ["mp3", "flac", "wav", "aac", "ogg", "m4a"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "xz"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "txt", "md"],
    "code": ["rs", "js", "ts", "tsx", "jsx", "py", "go", "java", "html", "css"],
    "installer": ["exe", "msi", "dmg", "pkg", "deb", "rpm"],
    "model": ["safetensors", "ckpt", "pt", "pth", "onnx", "gguf"],
}
#: Upper limits of the age bands in seconds, in order.
AGE_BANDS = [("lt1mo", 2_592_000), ("1to3mo", 7_776_000), ("3to6mo", 15_552_000), ("6to12mo", 31_536_000), ("1to2yr", 63_072_000)]
#: Fixed value: times before 1990 aren't trusted.
TRUSTED_SINCE = 631_152_000
DAY = 86_400


def extension(name: Column) -> Column:
    """Lower-cased last extension; null without one or for a name that only begins with a dot."""
    found = F.lower(F.regexp_extract(name, r"^.+\.([^./\\]+)$", 1))
    return F.when(found != "", found)


def parent(path: Column) -> Column:
    """Path up to the last separator of either kind."""
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def base_name(path: Column) -> Column:
    """Last segment of a path with either separator."""
    return F.regexp_extract(F.rtrim(path, F.lit("/\\")), r"([^/\\]*)$", 1)


def depth(path: Column) -> Column:
    """Path components, a root separator being one, after a drive too."""
    parts = F.size(F.filter(F.split(path, r"[/\\]"), lambda s: s != ""))
    return parts + F.when(path.rlike(r"^([A-Za-z]:)?[/\\]"), 1).otherwise(0)


def ancestors(path: Column) -> Column:
    """The path and each of its ancestors by either separator, longest first, up to an empty prefix (U4)."""
    parts = F.split(path, r"[/\\]")
    lengths = F.transform(parts, F.length)
    cut = lambda n: F.substring(path, F.lit(1), F.aggregate(F.slice(lengths, 1, n), F.lit(0), lambda a, x: a + x) + n - 1)
    return F.filter(F.transform(F.sequence(F.size(parts), F.lit(1)), cut), lambda p: p != "")


def above(path: Column) -> Column:
    """The ancestors of a path without itself, longest first."""
    return F.filter(ancestors(path), lambda p: p != path)


def normal(path: Column) -> Column:
    """Path with forward separators and none at its end."""
    return F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def folder_of(path: Column) -> Column:
    """Path up to the last forward separator; Root without one."""
    up = F.regexp_extract(path, r"^(.+)/[^/]*$", 1)
    return F.when(up != "", up).otherwise(F.lit("Root"))


def shown_extension(name: Column) -> Column:
    """Lower-cased text after the last dot, (none) without one."""
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when((last != "") & (last != F.lower(name)), last).otherwise(F.lit("(none)"))


def media_kind(ext: Column) -> Column:
    """Media kind of a lower-case extension."""
    out = F.lit("other")
    for kind, names in MEDIA_KINDS.items():
        out = F.when(ext.isin(names), F.lit(kind)).otherwise(out)
    return out


def age_band(modified: Column, as_of: int) -> Column:
    """Age band; a future time counts as the youngest."""
    age = F.lit(as_of) - modified
    out = F.lit("gt2yr")
    for band, limit in reversed(AGE_BANDS):
        out = F.when(age < limit, F.lit(band)).otherwise(out)
    return F.when(modified.isNull(), F.lit("unknown")).otherwise(out)


def month(modified: Column) -> Column:
    """YYYY-MM in UTC, or unknown (A4)."""
    return F.coalesce(F.date_format(F.timestamp_seconds(modified), "yyyy-MM"), F.lit("unknown"))


def trusted_age_days(modified: Column, as_of: int) -> Column:
    """Whole days of age, 0 at least; null for a missing or untrusted time."""
    return F.when(modified >= TRUSTED_SINCE, F.greatest(F.lit(0), F.floor((F.lit(as_of) - modified) / DAY))).cast("long")


def under(path: Column, prefix: str | Column) -> Column:
    """Is the path the prefix or below it; a prefix of separators only holds all."""
    stem = F.rtrim(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("/\\"))
    return (stem == "") | (path == stem) | path.startswith(F.concat(stem, F.lit("/"))) | path.startswith(F.concat(stem, F.lit("\\")))


def stem(name: Column) -> Column:
    """Trimmed, lower-cased name without its last extension (H3)."""
    return F.lower(F.trim(F.regexp_replace(F.trim(name), r"\.[^.]*$", "")))


def backup_stem(name: Column) -> Column:
    """Stem without one backup or copy suffix, trimmed again (H5)."""
    return F.trim(F.regexp_replace(stem(name), r"[ _-](backup|copy)$", ""))


def f32(value: Column) -> Column:
    """A confidence as single precision in a double."""
    return value.cast("float").cast("double")


def format_bytes(size: Column) -> Column:
    """Size in units of 1024, one decimal except for bytes."""
    units = ["KB", "MB", "GB", "TB", "PB"]
    out = F.format_string("%.1f PB", size / float(1024**5))
    for i in range(len(units) - 1, -1, -1):
        out = F.when(size < 1024 ** (i + 2), F.format_string(f"%.1f {units[i]}", size / float(1024 ** (i + 1)))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def format_count(value: Column) -> Column:
    """Whole number with commas between thousands."""
    return F.format_number(value, 0)


def format_age(days: Column) -> Column:
    """Age in days: today, days under a year, else years and days."""
    years, rest = F.floor(days / 365), days % 365
    long = F.concat(years.cast("string"), F.lit("y"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("d"))).otherwise(F.lit("")), F.lit(" ago"))
    return F.when(days <= 0, F.lit("today")).when(days < 365, F.concat(format_count(days), F.lit("d ago"))).otherwise(long)


def age_label(seconds: Column) -> Column:
    """Age in years with one decimal, or in months."""
    days = seconds / DAY
    return F.when(days >= 365, F.concat(F.format_string("%.1f", days / 365), F.lit(" yr"))).otherwise(F.concat(F.floor(days / 30 + 0.5).cast("string"), F.lit(" mo")))


def number_text(value: Column) -> Column:
    """A double as it stands in a JSON payload: shortest digits, a point always; an exponent only below 1e-5 and from 1e16 on."""
    java = F.regexp_extract(F.to_json(F.struct(value.cast("double").alias("v"))), r":([^}]*)", 1)
    sign, digits = F.regexp_extract(java, "^(-?)", 1), F.regexp_replace(F.regexp_extract(java, r"^-?([0-9.]+)E", 1), r"\.|\.?0$", "")
    power = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
    large = F.concat(sign, F.substring(whole, F.lit(1), power + 1), F.lit("."), F.when(F.length(whole) > power + 1, F.substring(whole, power + 2, F.length(whole))).otherwise(F.lit("0")))
    scientific = F.concat(sign, F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(F.lit("")), F.lit("e"), power.cast("string"))
    return F.when(power.isNull(), java).when(power.between(-5, -1), small).when(power.between(0, 15), large).otherwise(scientific)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs (U8)."""
    return F.bit_count(a.bitwiseXOR(b))


def source_priority(source: Column) -> Column:
    """Rank of a fact's source (K5)."""
    #: Priority by source, by its prefix where that ends with a colon.
    ranks = [("user", 100), ("extractor:", 80), ("rule:", 60), ("heuristic:", 40), ("phash", 30), ("ml:", 20), ("system", 10)]
    out = F.lit(0)
    for name, rank in reversed(ranks):
        out = F.when(source.startswith(name) if name.endswith(":") else source == name, F.lit(rank)).otherwise(out)
    return out


def any_of(conditions: list[Column]) -> Column:
    """Disjunction."""
    return reduce(Column.__or__, conditions)


def percent_text(part: Column, whole: Column) -> Column:
    """Rounded percentage, ``<1%`` between 0 and 1."""
    p = F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)
    return F.when((p > 0) & (p < 1), F.lit("<1%")).otherwise(F.concat(F.floor(p + 0.5).cast("string"), F.lit("%")))


def join_destination(folder: Column, name: Column) -> Column:
    """Name below a folder, in the folder's separator style."""
    sep = F.when(F.contains(folder, F.lit("\\")) & ~F.contains(folder, F.lit("/")), F.lit("\\")).otherwise(F.lit("/"))
    return F.concat(F.rtrim(folder, F.lit("/\\")), sep, name)


def relative_time(then: Column, as_of: int) -> Column:
    """How long ago, in the largest unit that fits."""
    age = F.greatest(F.lit(0), F.lit(as_of) - then)
    units = [(60, 1, "s"), (3600, 60, "m"), (DAY, 3600, "h"), (30 * DAY, DAY, "d"), (365 * DAY, 30 * DAY, "mo")]
    out = F.concat(F.floor(age / (365 * DAY)).cast("string"), F.lit("y ago"))
    for limit, unit, mark in reversed(units):
        out = F.when(age < limit, F.concat(F.floor(age / unit).cast("string"), F.lit(f"{mark} ago"))).otherwise(out)
    return F.when(then.isNull(), F.lit("never")).otherwise(out)
