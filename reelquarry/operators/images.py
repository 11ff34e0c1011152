"""Image operators over pixels (image_id, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alpha_stats(pixels: DataFrame) -> DataFrame:
    """Per image: whether alpha is constant, whether it is one bit, and its least value."""
    return pixels.groupBy("image_id").agg(
        (F.min("a") == F.max("a")).alias("constant"), F.bool_and(F.col("a").isin(0, 255)).alias("one_bit"), F.min("a").alias("least"), F.max("x").alias("max_x"), F.max("y").alias("max_y")
    )


def guess_format(stats: DataFrame, wanted: Column, capable: Column) -> DataFrame:
    """stats with the texture format: only DXT1 on images that can hold alpha is reconsidered."""
    guess = F.when(F.col("constant") & (F.col("least") == 255), "DXT1").when(F.col("constant") | F.col("one_bit"), "DXT3").otherwise("DXT5")
    return stats.withColumn("format", F.when((wanted == "DXT1") & capable, guess).otherwise(wanted))


def power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def mip_count(w: Column, h: Column) -> Column:
    return F.length(F.bin(F.greatest(w, h))).cast("long")


def next_mip(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """Half-size image by 2 x 2 means, truncated."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return pixels.groupBy("image_id", half("x"), half("y")).agg(*[F.floor(F.sum(c) / F.count(c)).cast("int").alias(c) for c in channels])


def slices(pixels: DataFrame, height: int) -> DataFrame:
    """A wide image as the slices of a volume: slice = x div h, x = x mod h."""
    return pixels.withColumns({"slice": F.floor(F.col("x") / height).cast("int"), "x": F.col("x") % height})


def pack_bgra(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.shiftleft(a.cast("long"), 24).bitwiseOR(F.shiftleft(r.cast("long"), 16)).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def from_embeddings(vectors: DataFrame, width: int = 8) -> DataFrame:
    """Stand-in pixels: 64 floats as width x 64 / width grey values of 0 to 255; alpha is the complement."""
    grey = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.55) * 231.8), F.lit(0)), F.lit(255)).cast("int")
    rows = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    v = grey(F.col("v"))
    return rows.select(
        "image_id", (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), v.alias("r"), F.shiftright(v, 1).alias("g"), (255 - v).alias("b"),
        F.when(F.col("image_id") % 4 == 0, 255).when(F.col("image_id") % 4 == 1, 128).when(F.col("image_id") % 4 == 2, F.when(v > 127, 255).otherwise(0)).otherwise(v).alias("a"),
    )


def signed_byte(x: Column) -> Column:
    """-1 .. 1 to a signed byte in two's complement, as 0 .. 255."""
    return F.pmod(F.round(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 127).cast("int"), F.lit(256))


def unit(x: Column, bits: int) -> Column:
    """An n-bit value as 0 .. 1."""
    return x / float((1 << bits) - 1)


def to_bits(x: Column, bits: int) -> Column:
    """0 .. 1 as an n-bit value, clamped."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * ((1 << bits) - 1) + 0.5).cast("long")


def pack_qwvu(q: Column, w: Column, v: Column, u: Column) -> Column:
    """Four signed components, -1 .. 1, in a 32-bit word."""
    return pack_bgra(signed_byte(v), signed_byte(w), signed_byte(u), signed_byte(q)).bitwiseAND(F.lit(0xFFFFFFFF))


def pack_12_12_8(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(to_bits(x, 12), 20).bitwiseOR(F.shiftleft(to_bits(y, 12), 8)).bitwiseOR(to_bits(z, 8))


def rgbe_to_float(mantissa: Column, exponent: Column) -> Column:
    """Shared-exponent colour: one channel's byte with the common exponent byte."""
    return F.when(exponent == 0, F.lit(0.0)).otherwise(mantissa * F.pow(F.lit(2.0), exponent - 136))


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luminance by the weights 0.3086, 0.6094 and 0.0820."""
    return r * 0.3086 + g * 0.6094 + b * 0.0820


def scale_bias(x: Column, scale: float, bias: float) -> Column:
    return F.floor(F.least(F.greatest(x * scale + bias, F.lit(0.0)), F.lit(255.0))).cast("int")


def wrapped(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Coordinates wrapped into the image."""
    return pixels.withColumns({"x": F.pmod("x", F.lit(width)), "y": F.pmod("y", F.lit(height))})


#: Words of texture formats on a command line with their long names, of which any other stands for DXT1.
TEXTURES = ("A8R8G8B8", "DXT1", "DXT1A", "DXT3", "DXT5", "X8R8G8B8", "R5G6B5")
#: Pixel formats that can hold alpha.
ALPHA_FORMATS = (
    "DXT2", "DXT3A", "DXT3A_1111", "DXT5", "DXT5A", "A1R5G5B5", "A4R4G4B4", "A8R8G8B8", "A8B8G8R8", "A2R10G10B10", "A2B10G10R10", "A2W10V10U10", "A16B16G16R16", "A16B16G16R16F",
    "A16B16G16R16F_EXPAND", "A32B32G32R32", "A32B32G32R32F",
)


def texture_format(word: Column) -> Column:
    """The texture format that a word asks for: DXT1 unless it is another one known."""
    return F.when(word.isin(*TEXTURES), word).otherwise("DXT1")


def alpha_capable(pixel_format: Column) -> Column:
    return F.coalesce(pixel_format.isin(*ALPHA_FORMATS), F.lit(False))


def with_alpha(pixels: DataFrame, value: int) -> DataFrame:
    return pixels.withColumn("a", F.lit(value))


def float_to_rgbe(r: Column, g: Column, b: Column) -> Column:
    """Three channels as bytes under the exponent byte of the largest: a struct of r, g, b, e; zeros for black."""
    most = F.greatest(r, g, b)
    e = F.floor(F.log2(F.when(most > 0, most).otherwise(1.0))) + 1
    e = F.when(most >= F.pow(F.lit(2.0), e), e + 1).when(most < F.pow(F.lit(2.0), e - 1), e - 1).otherwise(e)
    black = most < 1e-32
    byte = lambda x: F.when(black, 0).otherwise(F.floor(F.greatest(x, F.lit(0.0)) * F.pow(F.lit(2.0), 8 - e))).cast("int")
    return F.struct(byte(r).alias("r"), byte(g).alias("g"), byte(b).alias("b"), F.when(black, 0).otherwise(e + 128).cast("int").alias("e"))


def dot(a: list[Column], b: list[Column]) -> Column:
    """Sum of the products of two pixels' channels."""
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def wrap_byte(x: Column) -> Column:
    return F.pmod(x, F.lit(256))


def swap_red_blue(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"r": F.col("b"), "b": F.col("r")})


def contrast(x: Column, factor: float) -> Column:
    """Distance from middle grey scaled, clamped to a byte."""
    return F.floor(F.least(F.greatest((x - 127.5) * factor + 127.5, F.lit(0.0)), F.lit(255.0))).cast("int")


def compressed(pixels: DataFrame, kinds: DataFrame, mips: bool = True) -> DataFrame:
    """pixels (image_id, x, y, r, g, b, a) and kinds (image_id, format) to image_id, format, width, height, levels, dds, error.

    An image's pixels meet in one group, which holds one image. Sides that are no powers of two give an error.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.codecs import texture

    def one(t: pa.Table) -> pa.Table:
        kind, x, y = t["format"][0].as_py(), t["x"].to_numpy(), t["y"].to_numpy()
        w, h = int(x.max()) + 1, int(y.max()) + 1
        image = np.zeros((h, w, 4), np.uint8)
        for c, name in enumerate("rgba"):
            image[y, x, c] = t[name].to_numpy()
        row = {"image_id": t["image_id"][0].as_py(), "format": kind, "width": w, "height": h, "levels": None, "dds": None, "error": None}
        if kind not in texture.FORMATS:
            row["error"] = f"format {kind} isn't compressed"
        elif w & (w - 1) or h & (h - 1):
            row["error"] = "sides are no powers of two"
        else:
            levels = texture.mip_levels(image) if mips else [image]
            row |= {"levels": len(levels), "dds": texture.dds([texture.encode(m, kind) for m in levels], w, h, kind)}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("image_id", pa.int64()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("levels", pa.int32()), ("dds", pa.binary()), ("error", pa.string())])
    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "r", "g", "b", "a")]).join(kinds, "image_id")
    return rows.groupBy("image_id").applyInArrow(one, "image_id long, format string, width int, height int, levels int, dds binary, error string")


def load(spark, path: str) -> DataFrame:
    """Pixels of image files, as Spark's image source decodes them: image_id (the file's name), x, y, r, g, b, a and whether the file can hold alpha; broken files are left out."""
    import numpy as np
    import pyarrow as pa

    names = ["image_id", "x", "y", "r", "g", "b", "a", "capable"]

    def unpack(batches):
        for batch in batches:
            for origin, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(data, np.uint8).reshape(h * w, n)
                v = np.repeat(v, 3, axis=1) if n == 1 else v
                at = np.arange(h * w)
                columns = [at % w, at // w, v[:, 2], v[:, 1], v[:, 0], v[:, 3] if n == 4 else np.full(h * w, 255)]
                yield pa.RecordBatch.from_arrays([pa.array([origin] * (h * w)), *[pa.array(c.astype(np.int32)) for c in columns], pa.array([n == 4] * (h * w))], names)

    found = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return found.mapInArrow(unpack, "image_id string, x int, y int, r int, g int, b int, a int, capable boolean")
