"""Column functions: names, paths, dates, sizes, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by profile.
VIDEO = ("webm", "mp4", "gifv", "ogg")
CATALOG = ("jpg", "jpeg", "webp", "gif", "png", "bmp", "heic", "heif", *VIDEO)
DEDUPE_IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif")
DEDUPE_VIDEOS = ("mp4", "mov", "webm", "mkv", "ogg", "gifv")
UPLOADS = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "mp4", "mov", "webm")
SCALABLE = ("jpg", "jpeg", "png", "webp", "bmp", "heic", "heif")
HEIC = ("heic", "heif")
UPLOADED_VIDEO = ("mp4", "mov", "webm")
EXIF = ("jpg", "jpeg", "png", "webp", "heic", "heif", "gif", "bmp")
MIME = {
    "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "ogg": "video/ogg", "gifv": "video/mp4",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
}
#: Strictness level to distance in digits; level 0 is exact.
LEVELS = {0: None, 1: 4, 2: 12, 3: 20}


def extension(name: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def media_type(name: Column) -> Column:
    return F.when(extension(name).isin(*VIDEO), "video").otherwise("image")


def has_format(name: Column, formats: tuple[str, ...]) -> Column:
    return name.rlike(r"(?i)\.(" + "|".join(formats) + ")$")


def name_contains(name: Column, query: str) -> Column:
    """Trimmed, case-blind containment; a blank query holds for all."""
    wanted = query.strip().lower()
    return F.lower(name).contains(wanted) if wanted else F.lit(True)


def is_under(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def natural_key(name: Column) -> Column:
    """A string whose plain order compares digit runs as numbers: each run carries its length."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def one(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, one), "")


def natural_order(name: Column) -> Column:
    """Natural order that is blind to case and accents."""
    return F.collate(natural_key(name), "UNICODE_CI_AI")


def exif_timestamp(raw: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds of ``yyyy:MM:dd HH:mm:ss`` (or a T between), a prefix match in local time; null where invalid or not after 1970."""
    parts = [F.try_to_number(F.regexp_extract(raw, r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})", i), F.lit("9999")).cast("int") for i in range(1, 7)]
    ms = F.unix_millis(F.try_make_timestamp(*parts, F.lit(zone)))
    return F.when(ms > 0, ms)


def effective_date(original: Column, created: Column, mtime_ms: Column, is_image: Column, zone: str = "UTC") -> Column:
    found = F.coalesce(exif_timestamp(original, zone), exif_timestamp(created, zone))
    return F.coalesce(F.when(is_image, found), mtime_ms, F.lit(0).cast("long"))


def described_tags(tags: Column) -> Column:
    """Map of strings from a map of (description, values): the description, or where it is empty the values joined by a space."""
    return F.transform_values(tags, lambda _, t: F.coalesce(F.nullif(t["description"], F.lit("")), F.array_join(t["values"], " "), F.lit("")))


def camera_record(tags: Column) -> Column:
    """Struct of eight camera attributes from a map of raw tags, each the first non-empty of its alternatives; null if all are empty."""
    first = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names])
    fields = {
        "make": first("Make"), "model": first("Model"), "lens": first("LensModel", "Lens", "LensInfo"), "iso": first("ISOSpeedRatings", "ISO"),
        "aperture": first("FNumber", "ApertureValue"), "shutter": first("ExposureTime", "ShutterSpeedValue"), "focal_length": first("FocalLength"),
        "date": first("DateTimeOriginal", "CreateDate"),
    }
    return F.when(F.coalesce(*fields.values()).isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def format_bytes(n: Column) -> Column:
    """``512 B``, ``2.0 KB``, ``250 MB``: one decimal below 100 units."""
    n = n.cast("double")

    def unit(power: int, name: str) -> Column:
        v = n / F.lit(float(1024**power))
        short = F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)
        return F.concat(F.when(v < 100, short).otherwise(F.floor(v + 0.5).cast("string")), F.lit(f" {name}"))

    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, unit(1, "KB"))
        .when(n < 1024**3, unit(2, "MB"))
        .when(n < 1024**4, unit(3, "GB"))
        .otherwise(unit(4, "TB"))
    )


def media_url(path: Column, scheme: str = "media://local") -> Column:
    """Percent-encoded URL of a path; back slashes become slashes."""
    encoded = F.url_encode(F.replace(path, F.lit("\\"), F.lit("/")))
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(scheme), F.when(F.startswith(encoded, F.lit("/")), F.lit("")).otherwise(F.lit("/")), encoded)


def display_url(path: Column, width: int = 4096) -> Column:
    url = media_url(path)
    return F.when(has_format(path, SCALABLE), F.concat(url, F.lit(f"?w={width}"))).otherwise(url)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def resolve_path(base: Column, relative: Column) -> Column:
    """Absolute, normalised path; an absolute ``relative`` stands for itself."""
    joined = F.when(F.startswith(relative, F.lit("/")), relative).otherwise(F.concat(base, F.lit("/"), relative))
    empty = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        back = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        return F.when((part == "") | (part == "."), stack).when(part == "..", back).otherwise(F.array_append(stack, part))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/"), empty, step), "/"))


def relative_path(base: Column, path: Column) -> Column:
    """Path below ``base``; null if it is not below."""
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), path.substr(F.length(base) + 2, F.length(path)))


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, down to the first segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def mime_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit("application/octet-stream"))


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def variant_key(path: Column, mtime_ms: Column, size: Column, dim: Column) -> Column:
    return F.sha1(F.concat_ws(":", path, mtime_ms.cast("string"), size.cast("string"), F.coalesce(dim.cast("string"), F.lit("full"))))


def fit_square(width: Column, height: Column, n: int) -> Column:
    """Width and height inside a square of n, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(n)) / F.greatest(width, height))
    return F.struct(F.floor(width * scale + 0.5).cast("int").alias("width"), F.floor(height * scale + 0.5).cast("int").alias("height"))


def sanitise_name(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"[^A-Za-z0-9_.\- ]+", "_")


def pixel_area(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def sample_instant(duration: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(duration, F.lit(0.0)) / 2)


def caption(date_ms: Column, name: Column, tags: Column) -> Column:
    """Long date if known, else the name; then the tags."""
    head = F.when(F.coalesce(date_ms, F.lit(0)) != 0, F.date_format(F.timestamp_millis(date_ms), "MMMM d, yyyy")).otherwise(name)
    return F.concat_ws(" · ", head, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " · ")) if tags is not None else head


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./\\]+$", "")


def folder_key(roots: Column) -> Column:
    return F.concat_ws("|", roots)


def pack_digits(hash_: Column) -> Column:
    """A string of hexadecimal digits as 64-bit words of 15 digits each."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(hash_) - 1) / 15).cast("int")), lambda i: F.conv(hash_.substr(i * 15 + 1, F.lit(15)), 16, 10).cast("long"))


def digit_distance(a: Column, b: Column) -> Column:
    """Number of hexadecimal digits at which two packed hashes of equal length differ."""
    ones = F.lit(0x111111111111111)

    def word(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_ = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(any_.bitwiseAND(ones))

    return F.aggregate(F.zip_with(a, b, word), F.lit(0), lambda s, x: s + x)


def block_hash(bins: Column, bands: int = 4) -> Column:
    """Hexadecimal digits of a raster's blocks: a bit is set where a block is above its band's median.

    ``bins`` is an array of numbers, whose length ``bands`` divides into multiples of four.
    """
    # The array and each step bind what the next one uses, so that nothing is worked out once a band or a bit.
    return F.get(F.transform(F.array(bins), lambda whole: _block_digits(whole, bands)), 0)


def _block_digits(bins: Column, bands: int) -> Column:
    width = (F.size(bins) / bands).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice(bins, b * width + 1, width))
    sorted_ = F.transform(cut, lambda part: F.struct(part.alias("part"), F.sort_array(part).alias("order"), F.size(part).alias("n")))

    def middle(s: Column) -> Column:
        high, low = F.element_at(s.order, F.floor(s.n / 2).cast("int") + 1), F.element_at(s.order, F.ceil(s.n / 2).cast("int"))
        return F.struct(s.part.alias("part"), ((low + high) / 2).alias("median"))

    bits = F.transform(F.transform(sorted_, middle), lambda s: F.transform(s.part, lambda x: F.when(x > s.median, F.lit("1")).otherwise(F.lit("0"))))
    digits = lambda row: F.lower(F.lpad(F.conv(F.array_join(row, ""), 2, 16), F.floor((F.size(row) + 3) / 4).cast("int"), F.lit("0")))
    return F.array_join(F.transform(bits, digits), "")
