"""Numbers, keys, product flags, labels, parsing and formats."""

from pyspark.sql import functions as F

from mailgrid import schemas


def as_col(col):
    return F.col(col) if isinstance(col, str) else col


# --- numbers -------------------------------------------------------------------------------


def half_even(col):
    """Round to a whole number, halves to the even neighbour."""
    return F.rint(as_col(col).cast("double")).cast("bigint")


def pct_floor(col, divisor):
    """``floor(col / divisor)`` on whole numbers."""
    return F.floor(as_col(col) / F.lit(divisor)).cast("bigint")


# --- keys ----------------------------------------------------------------------------------


def compose_key(*cols, sep="~"):
    """Key from its parts; NULL parts are left out."""
    return F.concat_ws(sep, *[as_col(c) for c in cols])


def series_label(province="province", courier="courier"):
    """'province - courier'; NULL when either is NULL."""
    return F.concat(as_col(province), F.lit(" - "), as_col(courier))


def piece_id(*cols, prefix=None):
    """Id from the allocation key and the ordinal inside it: the same on every recomputation."""
    parts = ([F.lit(prefix)] if prefix else []) + [as_col(c).cast("string") for c in cols]
    return F.concat_ws("~", *parts)


# --- product flags -------------------------------------------------------------------------


def products_to_flags(products):
    """List of products to the flags p890, p_ar, p_rs (absent means false)."""
    products = as_col(products)
    return {
        "p890": F.coalesce(F.array_contains(products, "890"), F.lit(False)),
        "p_ar": F.coalesce(F.array_contains(products, "AR"), F.lit(False)),
        "p_rs": F.coalesce(F.array_contains(products, "RS"), F.lit(False)),
    }


def flags_to_products(p890="p890", p_ar="p_ar", style="export"):
    """'890,AR,RS' for exports, where RS is always listed, or '890-AR' for the sheet."""
    parts = [F.when(as_col(p890), "890"), F.when(as_col(p_ar), "AR")]
    if style == "export":
        return F.concat_ws(",", *parts, F.lit("RS"))
    return F.concat_ws("-", *parts)


def label_to_flags(label):
    label = as_col(label)
    return {"p890": label.contains("890"), "p_ar": label.contains("AR")}


# --- labels --------------------------------------------------------------------------------


def label_peak(col):
    col = as_col(col)
    return F.when(col == 0, schemas.PEAK_LABELS[0]).when(col == 1, schemas.PEAK_LABELS[1])


def band_ordinal(col):
    col = as_col(col)
    out = F.lit(None).cast("int")
    for band, ordinal in schemas.BAND_ORDINALS.items():
        out = F.when(col == band, ordinal).otherwise(out)
    return out


# --- parsing and formats -------------------------------------------------------------------


def parse_ts(col, fmt=None):
    """Timestamp without time zone; NULL when the text does not have the format."""
    col = as_col(col)
    if fmt is None:
        return F.try_to_timestamp(col).cast("timestamp_ntz")
    return F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")


def parse_dmy(col):
    return parse_ts(col, "dd/MM/yyyy").cast("date")


def hour_to_zero(text):
    """Sets the hour digits of an ISO timestamp text to 00, minutes and seconds kept."""
    text = as_col(text)
    return F.concat(F.substring(text, 1, 11), F.lit("00"), F.substr(text, F.lit(14)))


def iso_ms(col):
    """ISO-8601 in milliseconds, UTC: '2026-02-02T00:00:00.000Z'."""
    return F.date_format(as_col(col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def path_parts(path, base_depth):
    """Extraction date, month and file name of '<base>/yyyy/MM/dd/yyyy-MM/.../file'.

    ``base_depth`` is the number of path elements before the year.
    """
    parts = F.split(as_col(path), "/")
    day = F.concat_ws("-", *[F.get(parts, base_depth + i) for i in range(3)])
    return {
        "extract_date": F.to_date(day),
        "month": F.get(parts, base_depth + 3),
        "file_name": F.element_at(parts, -1),
    }


def decode_body(col, schema):
    """JSON text to a struct; malformed text gives NULL fields instead of failing the job."""
    return F.from_json(as_col(col), schema, {"mode": "PERMISSIVE"})


def flag_text(col):
    """'0' means false, anything else true."""
    return F.coalesce(as_col(col) != "0", F.lit(True))


def coalesce_defaults(df, defaults):
    """Replaces NULL by a default per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
