"""Formats of runs: effective font, category key, label and hint, as expressions over a format struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = T.StructType([
    T.StructField("font_ascii", T.StringType()), T.StructField("font_east_asia", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType()), T.StructField("highlight", T.StringType()),
    T.StructField("color", T.StringType()), T.StructField("underline", T.StringType()), T.StructField("strike", T.BooleanType()),
    T.StructField("dstrike", T.BooleanType()), T.StructField("vert_align", T.StringType()), T.StructField("small_caps", T.BooleanType())])

# The default font, short names, names of sizes in points, and words of labels.
DEFAULT_FONT = "宋体"
SHORT = {"Times New Roman": "TNR", "宋体": "SimSun"}
POINTS = {12: "小四", 14: "四号", 16: "三号", 18: "小二"}
BOLD, ITALIC, UNDERLINED, STRUCK, RAISED, LOWERED, CAPS, LIT, COLOUR, PLAIN = "加粗", "斜体", "下划线", "删除线", "上标", "下标", "小型大写", "高亮", "色", "默认"


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def font(fmt: Column) -> Column:
    """The East Asian font, else the Western one, else the default."""
    return F.coalesce(_given(fmt["font_east_asia"]), _given(fmt["font_ascii"]), F.lit(DEFAULT_FONT))


def struck(fmt: Column) -> Column:
    return F.coalesce(fmt["strike"], F.lit(False)) | F.coalesce(fmt["dstrike"], F.lit(False))


def category_key(fmt: Column) -> Column:
    """What two runs of one category have in common; null for a null format (a formula of its own)."""
    text = lambda name: F.coalesce(fmt[name], F.lit("")).alias(name)
    flag = lambda name: F.coalesce(fmt[name], F.lit(False)).alias(name)
    key = F.struct(font(fmt).alias("font"), F.coalesce(fmt["size"], F.lit(0)).alias("size"), flag("bold"), flag("italic"), text("highlight"),
                   text("color"), text("underline"), struck(fmt).alias("struck"), text("vert_align"), flag("small_caps"))
    return F.when(fmt.isNotNull(), key)


def label(fmt: Column) -> Column:
    """A readable label, its parts joined by ``/``."""
    short = font(fmt)
    for name, code in SHORT.items():
        short = F.replace(short, F.lit(name), F.lit(code))
    size = fmt["size"]
    points = F.concat(F.floor(F.abs(size) / 2).cast("int") * F.signum(size).cast("int"), F.lit("pt"))
    for number, name in POINTS.items():
        points = F.when(size == 2 * number, name).otherwise(points)
    vertical = fmt["vert_align"]
    parts = [
        _given(short), F.when(size != 0, points), F.when(fmt["bold"], BOLD), F.when(fmt["italic"], ITALIC), F.when(fmt["underline"] != "", UNDERLINED),
        F.when(struck(fmt), STRUCK), F.when(vertical == "superscript", RAISED), F.when(vertical == "subscript", LOWERED), F.when(fmt["small_caps"], CAPS),
        F.when(fmt["highlight"] != "", F.concat(F.lit(LIT), fmt["highlight"])), F.when((fmt["color"] != "") & (fmt["color"] != "000000"), F.concat(F.lit(COLOUR), fmt["color"]))]
    return F.coalesce(_given(F.concat_ws("/", *parts)), F.lit(PLAIN))


def hint(fmt: Column) -> Column:
    """A short hint for tags, its parts joined by ``,``; ``fmt`` if there is nothing to hint at."""
    name = font(fmt)
    other = F.when(~name.isin(DEFAULT_FONT, SHORT[DEFAULT_FONT]), F.replace(name, F.lit("Times New Roman"), F.lit(SHORT["Times New Roman"])))
    parts = [F.when(fmt["bold"], "b"), F.when(fmt["italic"], "i"), F.when(fmt["underline"] != "", "u"), F.when(struck(fmt), "s"), _given(F.substring(fmt["vert_align"], 1, 3)), other]
    return F.coalesce(_given(F.concat_ws(",", *parts)), F.lit("fmt"))


def tagged(category: Column, hint_text: Column, text: Column) -> Column:
    return F.concat(F.lit("‹"), category, F.lit(":"), hint_text, F.lit("›"), text, F.lit("‹/›"))
