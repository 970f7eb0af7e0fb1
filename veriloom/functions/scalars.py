"""Scalar functions of media records as Column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_TYPE_BASE = "http://cv.iptc.org/newscodes/digitalsourcetype/"
# Labels of source types, and whether a device captured them.
SOURCE_TYPES = {
    "digitalCapture": ("Digital Capture", True),
    "computationalCapture": ("Computational Capture", True),
    "multipleExposures": ("Multiple Exposures", True),
    "trainedAlgorithmicMedia": ("AI Generated", False),
    "compositeSynthetic": ("Composite / Synthetic", False),
    "algorithmicMedia": ("Algorithmic Media", False),
    "softwareImage": ("Software Image", False),
    "virtualRecording": ("Virtual Recording", False),
    "scannedImage": ("Scanned Image", False),
}
# File extensions by MIME type, of object storage, of presigned uploads and of the upload page.
STORE_EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/webp": "webp", "image/heic": "heic", "image/heif": "heif",
    "video/mp4": "mp4", "video/quicktime": "mov", "video/x-msvideo": "avi",
}
UPLOAD_EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/avif": "avif", "video/mp4": "mp4", "video/quicktime": "mov",
    "application/json": "json", "application/octet-stream": "bin",
}
PAGE_EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/avif": "avif", "video/mp4": "mp4", "video/quicktime": "mov"}
#: Lamports in a SOL.
UNIT = 1_000_000_000


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x: Column | str) -> Column:
    """Null or the empty string."""
    return c(x).isNull() | (c(x) == "")


def or_else(*xs: Column | str) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*[F.when(c(x) != "", c(x)) for x in xs])


def choose(key: Column, table: dict, default: Column | None = None) -> Column:
    """A lookup in a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if default is not None else F.lit(None))


def dot(a: Column, b: Column) -> Column:
    """Sum of products as doubles, left to right; null if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column | str, b: Column | str, b_squared: Column | None = None) -> Column:
    """dot(a, b) / sqrt(dot(a, a) * dot(b, b)); null for a vector of zeros. b_squared: dot(b, b), where it is known."""
    a, b = c(a), c(b)
    norm = F.sqrt(dot(a, a) * (dot(b, b) if b_squared is None else b_squared))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_text(v: Column | str) -> Column:
    """[a,b,...]"""
    return F.concat(F.lit("["), F.array_join(c(v).cast("array<string>"), ","), F.lit("]"))


def bytes_hex(x: Column | str) -> Column:
    """Lower-case hex, two digits a byte, of an array of integers."""
    return F.array_join(F.transform(c(x), lambda b: F.lower(F.lpad(F.hex(b.cast("long")), 2, "0"))), "")


def binary_hex(x: Column | str) -> Column:
    return F.lower(F.hex(c(x)))


def instance_hash(instance_id: Column | str) -> Column:
    """iid_ and the id without its first urn:uuid:."""
    x, prefix = c(instance_id), "urn:uuid:"
    at = F.locate(prefix, x)
    return F.concat(F.lit("iid_"), F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + len(prefix), F.length(x)))).otherwise(x))


def source_type(uri: Column | str) -> Column:
    """Capture and trained media by name (case counts), others as the URI; empty as null."""
    u = F.when(c(uri) != "", c(uri))
    return F.when(u == SOURCE_TYPE_BASE + "digitalCapture", "digitalCapture").when(u.contains("trainedAlgorithmicMedia"), "trainedAlgorithmicMedia").otherwise(u)


def source_type_key(uri: Column | str) -> Column:
    """The last part of the path; the whole URI if that is empty."""
    return F.coalesce(F.nullif(F.substring_index(c(uri), "/", -1), F.lit("")), c(uri))


def source_type_label(uri: Column | str) -> Column:
    key = source_type_key(uri)
    return F.when(missing(uri), "Unknown").otherwise(choose(key, {k: v[0] for k, v in SOURCE_TYPES.items()}, key))


def is_hardware(uri: Column | str) -> Column:
    return F.coalesce(source_type_key(uri).isin([k for k, v in SOURCE_TYPES.items() if v[1]]), F.lit(False))


def generator_text(generator: Column | str, name: Column | str, version: Column | str) -> Column:
    """The generator, else name and version, else Unknown."""
    both = F.when(~missing(name), F.concat_ws(" ", c(name), F.when(~missing(version), c(version))))
    return F.coalesce(or_else(generator), both, F.lit("Unknown"))


def generator_name(generator: Column | str) -> Column:
    """What stands before the first ' 8', trimmed."""
    return F.trim(F.substring_index(c(generator), " 8", 1))


def action_display(action: Column | str) -> Column:
    return F.upper(F.replace(F.substring_index(c(action), ".", -1), F.lit("_"), F.lit(" ")))


def is_ai_action(uri: Column | str, description: Column | str) -> Column:
    exact = c(uri) == SOURCE_TYPE_BASE + "trainedAlgorithmicMedia"
    return F.coalesce(exact, F.lit(False)) | F.coalesce(F.lower(c(description)).contains("generative ai"), F.lit(False))


def is_listed_ai_action(uri: Column | str, description: Column | str) -> Column:
    """The display's own test: a capital T, so the composite kind counts and the plain one doesn't."""
    return F.coalesce(c(uri).contains("TrainedAlgorithmicMedia"), F.lit(False)) | F.coalesce(F.lower(c(description)).contains("generative ai"), F.lit(False))


def is_composite(uri: Column | str) -> Column:
    return F.coalesce(c(uri).contains("compositeWithTrainedAlgorithmicMedia"), F.lit(False))


def is_trusted_issuer(issuer: Column | str, matchers: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, matchers)), lambda m: F.contains(c(issuer), m)), F.lit(False))


def extension_of(mime: Column | str, table: dict[str, str] = STORE_EXTENSIONS) -> Column:
    return choose(c(mime), table, F.lit("bin"))


def path_extension(path: Column | str) -> Column:
    """After the last dot, the whole path without one; bin if that is empty or null."""
    return F.coalesce(F.nullif(F.substring_index(c(path), ".", -1), F.lit("")), F.lit("bin"))


def object_key(content_hash: Column | str, kind: str, extension: Column | str | None = None) -> Column:
    """Where an object of a record is kept: original, sidecar, qr_watermarked, manifest or thumbnail."""
    extension = F.lit("bin") if extension is None else c(extension)
    name = {
        "original": F.concat(F.lit("original."), extension),
        "sidecar": F.lit("metadata.c2pa"),
        "qr_watermarked": F.concat(F.lit("qr_watermarked."), extension),
        "manifest": F.lit("manifest.json"),
        "thumbnail": F.lit("thumbnail.jpg"),
    }[kind]
    return F.concat(F.lit("media/"), c(content_hash), F.lit("/"), name)


def truncated(x: Column | str, head: int, tail: int) -> Column:
    return F.concat(F.left(c(x), F.lit(head)), F.lit("..."), F.right(c(x), F.lit(tail)))


def price_parse(text: Column | str, nan_as_zero: bool = False) -> Column:
    """floor(number * UNIT) of the leading number; empty or null is 0, none gives null (or 0)."""
    t = F.coalesce(F.when(c(text) != "", c(text)), F.lit("0"))
    number = F.regexp_extract(t, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    value = F.floor(number.try_cast("double") * UNIT)
    return F.coalesce(value, F.lit(0).cast("long")) if nan_as_zero else value


def price_display(lamports: Column | str, digits: int = 2) -> Column:
    """free, or the amount in SOL."""
    return F.when(c(lamports) == 0, "free").otherwise(F.concat(F.format_string(f"%.{digits}f", c(lamports).cast("double") / UNIT), F.lit(" SOL")))


def percent(x: Column | str) -> Column:
    """Half up to whole percents."""
    return F.floor(c(x) * 100 + 0.5)


def gateway(url: Column | str, default: str = "https://gateway.example") -> Column:
    return F.when(c(url).contains("devnet"), c(url)).otherwise(F.lit(default))


def without_prefix(uri: Column | str, prefix: str) -> Column:
    """The URI with the prefix's first occurrence taken out; others stay whole."""
    x = c(uri)
    at = F.locate(prefix, x)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + len(prefix), F.length(x)))).otherwise(x)


def epoch_seconds(ms: Column | str) -> Column:
    return F.coalesce(F.floor(c(ms) / 1000), F.lit(0).cast("long"))


def created_at(attribute: Column | str, seconds: Column | str) -> Column:
    """The attribute, else the time in ISO form."""
    return F.coalesce(or_else(attribute), F.date_format(F.timestamp_seconds(c(seconds)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def expiry(now: Column | str) -> Column:
    return c(now) + F.expr("INTERVAL 24 HOURS")


def assertion_label(key: Column | str, descriptions: dict[str, str]) -> Column:
    """The description of the key without its __n, and '#n+1' where it has one; a key without a description as it is."""
    k = c(key)
    number = F.regexp_extract(k, r"__(\d+)$", 1)
    said = choose(F.regexp_replace(k, r"__\d+$", ""), descriptions)
    return F.when(said.isNull(), k).when(number == "", said).otherwise(F.concat(said, F.lit(" #"), (number.try_cast("long") + 1).cast("string")))


def binary_preview(x: Column | str) -> Column:
    """Length and first 8 values."""
    return F.concat(F.lit("[binary: "), F.size(c(x)).cast("string"), F.lit(" bytes] ("), F.array_join(F.slice(c(x), 1, 8).cast("array<string>"), ", "), F.lit("...)"))


def looks_like_json(x: Column | str) -> Column:
    return F.coalesce(c(x).contains("\n") | c(x).startswith("[") | c(x).startswith("{"), F.lit(False))


def has_gps(*fields: Column | str) -> Column:
    return F.coalesce(*[c(f).cast("string") for f in fields]).isNotNull()


def camera(make: Column | str, model: Column | str) -> Column:
    """Make and model; null without either."""
    both = F.trim(F.concat(F.coalesce(c(make), F.lit("")), F.lit(" "), F.coalesce(c(model), F.lit(""))))
    return F.when(~(missing(make) & missing(model)), both)


def exif_date(original: Column | str, changed: Column | str) -> Column:
    """When a picture was taken, else when it was changed, as text; empty texts and zeros are missing."""
    said = lambda x: F.when(~c(x).cast("string").isin("", "0"), c(x).cast("string"))
    return F.coalesce(said(original), said(changed))


def fitted(width: Column | str, height: Column | str, most: int = 512) -> Column:
    """(width, height) within a square of this size, the ratio kept, rounded half up; smaller ones stay."""
    w, h = c(width).cast("double"), c(height).cast("double")
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    side = lambda x: F.floor(x * scale + 0.5).cast("int")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def title_or_file(title: Column | str, file_name: Column | str) -> Column:
    """The title, else the file's name before its first dot."""
    return F.coalesce(or_else(title), F.substring_index(c(file_name), ".", 1))


def progress_percent(x: Column | str) -> Column:
    """Rounded half up."""
    return F.floor(c(x) + 0.5)


def seeded_token(seed: str, *keys: Column | str) -> Column:
    """64 hex digits that follow from the seed and the keys, so reruns agree; null keys are left out."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[c(k).cast("string") for k in keys]), 256)


def search_route(content_type: Column | str) -> Column:
    """By the request's type: a form with an image, a JSON text, or neither."""
    has = lambda part: F.coalesce(c(content_type).contains(part), F.lit(False))
    return F.when(has("multipart/form-data"), "image").when(has("application/json"), "text").otherwise("unsupported")


def page_window(page: Column | str, pages: Column | str, most: int = 7) -> Column:
    """The numbers of the page buttons: at most so many, around the page."""
    first = F.greatest(F.lit(1), c(page) - most // 2)
    last = F.least(c(pages), first + most - 1)
    first = F.when(last - first < most - 1, F.greatest(F.lit(1), last - most + 1)).otherwise(first)
    return F.when(c(pages) > 0, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
