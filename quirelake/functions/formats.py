"""Number formats of spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Built-in number formats of spreadsheets, by id.
NUMBER_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0;(#,##0)", 38: "#,##0;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}


def number_format(number: Column) -> Column:
    """The code of a built-in format; null for the general one and for numbers that mean nothing. The lookup is a constant."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in NUMBER_FORMATS.items() for x in pair]), number)
