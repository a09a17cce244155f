"""Media kinds, units, throughput, telemetry, and the small decision tables of the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloft.functions.core import col, js_round, non_empty

#: Extensions by media type; the second pair is the smaller one of a listed entry's kind.
PHOTO = ".3fr .arw .avif .cr2 .cr3 .dng .erf .fff .heic .heif .iiq .jpeg .jpg .jxl .kdc .mef .mos .mrw .nef .nrw .orf .pef .png .raf .raw .rw2 .rwl .sr2 .srf .srw .tif .tiff .webp .x3f".split()
VIDEO = ".3gp .avi .insv .lrv .m2t .m2ts .m4v .mkv .mov .mp4 .mpeg .mpg .mts .r3d .webm".split()
KIND_IMAGE = ".jpg .jpeg .png .heic .heif .tif .tiff .dng .raw .arw .cr2 .cr3 .nef .orf .pef .raf .rw2 .srw".split()
KIND_VIDEO = ".3gp .avi .m2ts .m4v .mov .mp4 .mpeg .mpg .mts .webm .mkv".split()
BASELINE, SLOW_RATIO, HISTORY = 5_000_000, 0.5, 3
RETRY_FIRST_MS, RETRY_MOST_MS = 30_000, 3_600_000
#: Error codes that may be shown, and what is said about them.
MESSAGES = {
    "SOURCE_UNAVAILABLE": "The source became unavailable.",
    "DESTINATION_INVALID": "The destination is no longer writable.",
    "INGEST_CANCELLED": "Ingest cancelled. You can return home or choose the folders again.",
    "COPY_CANCELLED": "Ingest cancelled. You can return home or choose the folders again.",
    "READ_FAILED": "A media file could not be copied.",
    "WRITE_FAILED": "A media file could not be copied.",
    "COPY_FAILED": "A media file could not be copied.",
    "DESTINATION_COLLISION": "A destination file appeared during ingest.",
}
OTHER_MESSAGE, OTHER_CODE = "The ingest could not be completed.", "INGEST_FAILED"


def media_type(extension, mime_type=None) -> Column:
    """photo, video or unknown; a recognised MIME type wins over the extension."""
    ext = F.lower(F.when(col(extension).startswith("."), col(extension)).otherwise(F.concat(F.lit("."), col(extension))))
    by_ext = F.when(ext.isin(PHOTO), "photo").when(ext.isin(VIDEO), "video").otherwise("unknown")
    if mime_type is None:
        return by_ext
    mime = F.lower(F.trim(col(mime_type)))
    return F.when(mime.startswith("image/"), "photo").when(mime.startswith("video/"), "video").otherwise(by_ext)


def media_kind(extension) -> Column:
    return F.when(col(extension).isin(KIND_IMAGE), "image").when(col(extension).isin(KIND_VIDEO), "video").otherwise("other")


def evaluate_throughput(current, average, samples) -> Column:
    """struct(is_slow, reason): from three samples on against half the mean, else against a fixed floor."""
    history = col(average).isNotNull() & (col(samples) >= HISTORY)
    slow = F.when(history, col(current) < col(average) * SLOW_RATIO).otherwise(col(current) < BASELINE)
    reason = F.when(~slow, "normal").when(history, "below-historical-average").otherwise("below-baseline")
    return F.struct(slow.alias("is_slow"), reason.alias("reason"))


def progress_telemetry(total, completed, rate) -> Column:
    """struct(percent, eta_seconds, remaining_bytes)."""
    finite = lambda c: F.coalesce(F.when(F.isnan(col(c).cast("double")) | (F.abs(col(c).cast("double")) == float("inf")), None).otherwise(col(c)), F.lit(0))
    t = F.greatest(finite(total), F.lit(0))
    done = F.least(F.greatest(finite(completed), F.lit(0)), t)
    left = t - done
    percent = F.when(t == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), js_round(done / t * 100).cast("int")))).cast("int")
    eta = F.when((left == 0) | (finite(rate) <= 0), None).otherwise(F.ceil(left / finite(rate)).cast("long"))
    return F.struct(percent.alias("percent"), eta.alias("eta_seconds"), left.cast("long").alias("remaining_bytes"))


def exact_bytes(size, halves: str = "up") -> Column:
    """A whole number of bytes in the unit that suits it, and in full. Tenths are rounded in whole numbers, so that only an
    exact half is one; it goes `up`, or to the `even` tenth, as printf does."""
    b = col(size).cast("long")

    def scaled(p: int, unit: str) -> Column:
        bits, whole = 10 * p, 1024**p
        tenths = F.shiftright(b, bits) * 10 + F.shiftright(b.bitwiseAND(whole - 1) * 10, bits)
        rest = (b.bitwiseAND(whole - 1) * 10).bitwiseAND(whole - 1) * 2
        more = (rest > whole) | ((rest == whole) & (F.lit(True) if halves == "up" else tenths % 2 == 1))
        tenths = tenths + more.cast("long")
        return F.format_string(f"%d.%d {unit}", ((tenths - tenths % 10) / 10).cast("long"), tenths % 10)

    human = F.when(b < 1024, F.format_string("%d B", b)).when(b < 1024**2, scaled(1, "KiB")).when(b < 1024**3, scaled(2, "MiB")).otherwise(scaled(3, "GiB"))
    return F.concat(human, F.lit(" ("), F.format_number(b, 0), F.lit(" B)"))


def capacity_bucket(size) -> Column:
    """The power of two nearest to a capacity on a logarithmic scale; null where it isn't positive."""
    return F.when(col(size) > 0, F.pow(F.lit(2.0), js_round(F.log2(col(size)))).cast("long"))


def poster_second(duration) -> Column:
    return F.least(F.lit(4.0), F.greatest(F.lit(0.0), col(duration) / 3))


def phase_label(status) -> Column:
    return F.concat(F.upper(F.left(col(status), F.lit(1))), F.substring(col(status), F.lit(2), F.length(col(status))))


def count_label(n, singular: str = "item") -> Column:
    return F.concat(F.format_number(col(n), 0), F.lit(f" {singular}"), F.when(col(n) == 1, "").otherwise("s"))


def day_label(day, n) -> Column:
    return F.concat(col(day), F.lit(": "), count_label(n))


def is_nickname(text) -> Column:
    """Kebab case, 1 to 63 characters."""
    return F.coalesce(col(text).rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$") & F.length(col(text)).between(1, 63), F.lit(False))


def safe_error(code) -> Column:
    """struct(code, message) that may be shown."""
    c = col(code)
    message = F.lit(OTHER_MESSAGE)
    for k, v in MESSAGES.items():
        message = F.when(c == k, v).otherwise(message)
    return F.struct(F.when(c.isin(*MESSAGES), c).otherwise(OTHER_CODE).alias("code"), message.alias("message"))


def recovery_error(status) -> Column:
    s = col(status)
    code = F.when(s == "cancelled", "RECOVERY_CLEANED").when(s == "failed", "RECOVERY_FAILED")
    message = F.when(s == "cancelled", "Interrupted ingest cleaned safely.").when(s == "failed", "Recovery failed. The session remains visible.")
    return F.struct(code.alias("error_code"), message.alias("error_message"))


def audit_kind(action, confidence) -> Column:
    """How a source came to its identity: confirmed by the user, new, or by its strong id."""
    return F.when(col(action) == "existing", "confirmed-existing").when(col(action) == "new", "created-new").when(col(confidence) == "exact", "auto-strong").otherwise("created-new")


def reacquired_decision(strong_before, strong_now, print_before, print_now, confirmed) -> Column:
    """Whether a source that comes back for recovery is the one that was interrupted."""
    same = F.coalesce(col(strong_before) == col(strong_now), F.lit(False))
    conflict = F.coalesce(col(strong_before) != col(strong_now), F.lit(False))
    by_print = F.coalesce(col(print_before) == col(print_now), F.lit(False))
    return F.when(same | (by_print & ~conflict), "confirmed-strong-or-fingerprint").when(col(confirmed), "user-confirmed-mismatch").otherwise("rejected-mismatch")


def retry_delay_ms(attempts) -> Column:
    return F.least(F.lit(RETRY_MOST_MS), RETRY_FIRST_MS * F.pow(F.lit(2.0), F.least(col(attempts) - 1, F.lit(30)))).cast("long")


def next_retry_ms(updated_ms, attempts, most) -> Column:
    """When a failed thumbnail may be tried again; null once its attempts are used up."""
    return F.when(col(attempts) < col(most), col(updated_ms) + retry_delay_ms(attempts))


def retry_due(state, attempts, most, next_ms, now_ms) -> Column:
    """A thumbnail is wanted where there's none, or where a failed one has attempts left and is due."""
    return col(state).isNull() | ((col(state) == "failed") & (col(attempts) < col(most)) & (col(next_ms).isNull() | (col(next_ms) <= now_ms)))


def same_facts(size_a, time_a, id_a, size_b, time_b, id_b) -> Column:
    """Two views of a file agree: size, time, and the file id where both have one."""
    return (col(size_a) == col(size_b)) & (col(time_a) == col(time_b)) & (col(id_a).isNull() | col(id_b).isNull() | (col(id_a) == col(id_b)))


def normalize_tags(tags) -> Column:
    """Tags of a metadata reader (a map of texts) as a struct; warnings come as a JSON array or a text."""
    t = lambda k: F.element_at(col(tags), F.lit(k))

    def number(*keys):
        v = F.coalesce(*[t(k) for k in keys]).try_cast("double")
        return F.when((v >= 0) & (v < float("inf")), v)

    present = lambda k: F.coalesce(F.trim(t(k)) != "", F.lit(False))
    listed = lambda k: F.coalesce(F.from_json(t(k), "array<string>"), F.array(t(k)))
    warnings = F.filter(F.transform(F.concat(listed("Warning"), listed("warnings"), listed("errors")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.struct(
        non_empty(t("Make")).alias("camera_make"), non_empty(t("Model")).alias("camera_model"), non_empty(t("LensModel")).alias("lens_model"), non_empty(t("MIMEType")).alias("mime_type"), non_empty(t("FileType")).alias("file_type"),
        number("ImageWidth", "SourceImageWidth").alias("width"), number("ImageHeight", "SourceImageHeight").alias("height"), number("Duration").alias("duration_seconds"),
        ((present("GPSLatitude") & present("GPSLongitude")) | present("GPSPosition") | present("GPSCoordinates")).alias("gps_present"), warnings.alias("warnings"),
    )


def thumbnail_union(id, state, cache_key, mime, width, height, error_code, message, attempts, next_retry, most) -> Column:
    """A tagged struct: none, ready with its artifact, or failed with its error and whether it can be tried again."""
    kind = F.when(col(id).isNull(), "none").when((col(state) == "ready") & col(mime).isNotNull(), "ready").otherwise("failed")
    ready = F.struct(col(cache_key).alias("cache_key"), col(mime).alias("mime_type"), col(width).alias("width"), col(height).alias("height"))
    failed = F.struct(col(error_code).alias("error_code"), col(message).alias("message"), col(attempts).alias("attempts"), col(next_retry).alias("next_retry_at"), (col(attempts) < col(most)).alias("retryable"))
    return F.struct(kind.alias("kind"), F.when(kind == "ready", ready).alias("ready"), F.when(kind == "failed", failed).alias("failed"))


