"""Friendly names of cameras from a maker and a model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of phones by the device code that their pictures carry.
IPHONES = {
    "iPhone1,1": "iPhone", "iPhone1,2": "iPhone 3G", "iPhone2,1": "iPhone 3GS", "iPhone3,1": "iPhone 4", "iPhone3,2": "iPhone 4", "iPhone3,3": "iPhone 4", "iPhone4,1": "iPhone 4S",
    "iPhone5,1": "iPhone 5", "iPhone5,2": "iPhone 5", "iPhone5,3": "iPhone 5c", "iPhone5,4": "iPhone 5c", "iPhone6,1": "iPhone 5s", "iPhone6,2": "iPhone 5s", "iPhone7,1": "iPhone 6 Plus", "iPhone7,2": "iPhone 6",
    "iPhone8,1": "iPhone 6s", "iPhone8,2": "iPhone 6s Plus", "iPhone8,4": "iPhone SE", "iPhone9,1": "iPhone 7", "iPhone9,3": "iPhone 7", "iPhone9,2": "iPhone 7 Plus", "iPhone9,4": "iPhone 7 Plus",
    "iPhone10,1": "iPhone 8", "iPhone10,4": "iPhone 8", "iPhone10,2": "iPhone 8 Plus", "iPhone10,5": "iPhone 8 Plus", "iPhone10,3": "iPhone X", "iPhone10,6": "iPhone X",
    "iPhone11,2": "iPhone XS", "iPhone11,4": "iPhone XS Max", "iPhone11,6": "iPhone XS Max", "iPhone11,8": "iPhone XR", "iPhone12,1": "iPhone 11", "iPhone12,3": "iPhone 11 Pro", "iPhone12,5": "iPhone 11 Pro Max",
    "iPhone12,8": "iPhone SE (2nd gen)", "iPhone13,1": "iPhone 12 mini", "iPhone13,2": "iPhone 12", "iPhone13,3": "iPhone 12 Pro", "iPhone13,4": "iPhone 12 Pro Max", "iPhone14,2": "iPhone 13 Pro",
    "iPhone14,3": "iPhone 13 Pro Max", "iPhone14,4": "iPhone 13 mini", "iPhone14,5": "iPhone 13", "iPhone14,6": "iPhone SE (3rd gen)", "iPhone14,7": "iPhone 14", "iPhone14,8": "iPhone 14 Plus",
    "iPhone15,2": "iPhone 14 Pro", "iPhone15,3": "iPhone 14 Pro Max", "iPhone15,4": "iPhone 15", "iPhone15,5": "iPhone 15 Plus", "iPhone16,1": "iPhone 15 Pro", "iPhone16,2": "iPhone 15 Pro Max",
    "iPhone17,1": "iPhone 16 Pro", "iPhone17,2": "iPhone 16 Pro Max", "iPhone17,3": "iPhone 16", "iPhone17,4": "iPhone 16 Plus",
}
# Model codes of cameras whose name is the code with a generation.
ALPHAS = "7 7M2 7M3 7M4 7M5 7R 7RM2 7RM3 7RM4 7RM5 7S 7SM2 7SM3 7C 7CM2 9 9M2 9M3 1 5100 6000 6100 6300 6400 6500 6600 6700".split()
COMPACTS = "RX100 RX100M2 RX100M3 RX100M4 RX100M5 RX100M5A RX100M6 RX100M7 RX10 RX10M2 RX10M3 RX10M4 RX1 RX1RM2".split()
# Further phones by name and model codes.
PHONES = {
    "Xiaomi Poco X3 NFC": "M2007J20CI M2007J20CG M2007J20CT", "Xiaomi Mi 10T Lite": "M2007J17G M2007J17I", "Xiaomi Mi 10T Pro": "M2007J3SY M2007J3SI", "Xiaomi Mi 10T": "M2007J3SG",
    "Xiaomi Poco X3 Pro": "M2102J20SG M2102J20SI", "Xiaomi Mi 11i": "M2102J2SG M2102J2SI", "Xiaomi Mi 11": "M2102K1G M2102K1AC", "Xiaomi Redmi Note 10": "M2103K19PG M2103K19PI",
    "Xiaomi Redmi Note 10 Pro": "M2101K6G M2101K6P M2101K6R", "Xiaomi Redmi 9T": "M2010J19SG M2010J19SI M2010J19CI", "Xiaomi Redmi Note 11 Pro": "21091116UG 21091116UI", "Xiaomi Redmi Note 11": "2201116TG 2201116TI",
    "Xiaomi Redmi Note 11S": "2201117TG 2201117TI", "Xiaomi 12": "2203121C 2203129G", "Xiaomi 12 Pro": "2201123G 2201122G", "Xiaomi 13": "2210132C 2210132G", "Xiaomi 13 Pro": "2211133G 2211133C",
    "Xiaomi 13 Lite": "23049PCD8G 23049PCD8I", "Xiaomi 14": "23116PN5BC 23116PN5BG", "Xiaomi 14 Pro": "23117RA68G 23127PN0CG",
    "OnePlus 7": "GM1900 GM1903 GM1905 GM1911 GM1913 GM1915 GM1917", "OnePlus 7 Pro": "GM1910 GM1911A GM1913A GM1917A", "OnePlus 7T": "HD1900 HD1901 HD1903 HD1905 HD1907", "OnePlus 7T Pro": "HD1910 HD1911 HD1913",
    "OnePlus 8": "IN2010 IN2013 IN2015 IN2017 IN2019", "OnePlus 8 Pro": "IN2020 IN2023 IN2025", "OnePlus 8T": "KB2000 KB2001 KB2003 KB2005 KB2007",
    "OnePlus 9": "LE2110 LE2111 LE2113 LE2115 LE2117 LE2119 LE2121", "OnePlus 9 Pro": "LE2120 LE2123 LE2125 LE2127", "OnePlus 10 Pro": "NE2210 NE2211 NE2213 NE2215", "OnePlus 11": "PHB110 PHB120",
    "OnePlus Nord": "AC2001 AC2003", "OnePlus Nord 2": "DN2101 DN2103", "Realme 7 Pro": "RMX2202 RMX2200", "Realme 8 Pro": "RMX3081 RMX3085", "Realme 8": "RMX3151", "Realme GT": "RMX3370 RMX3371", "Realme GT Neo 3": "RMX3711 RMX3712",
    "Oppo Find X3 Pro": "CPH2173 CPH2179", "Oppo Find X5 Pro": "PEXM00", "Samsung Galaxy S21": "SM-G991B SM-G991U SM-G991N", "Samsung Galaxy S21+": "SM-G996B SM-G996U SM-G996N", "Samsung Galaxy S21 Ultra": "SM-G998B SM-G998U SM-G998N",
    "Samsung Galaxy S22": "SM-S901B SM-S901U SM-S901N", "Samsung Galaxy S22+": "SM-S906B SM-S906U SM-S906N", "Samsung Galaxy S22 Ultra": "SM-S908B SM-S908U SM-S908N", "Samsung Galaxy S23": "SM-S911B SM-S911U SM-S911N",
    "Samsung Galaxy S23+": "SM-S916B SM-S916U SM-S916N", "Samsung Galaxy S23 Ultra": "SM-S918B SM-S918U SM-S918N", "Samsung Galaxy S24": "SM-S921B SM-S921U SM-S921N", "Samsung Galaxy S24+": "SM-S926B SM-S926U SM-S926N",
    "Samsung Galaxy S24 Ultra": "SM-S928B SM-S928U SM-S928N", "Asus ROG Phone 6": "ASUS_AI2202",
}
_ROMAN = ["", "", "II", "III", "IV", "V", "VI", "VII"]


def _generation(code: str) -> str:
    """'7RM4' -> '7R IV', 'RX100M5A' -> 'RX100 VA'."""
    m = re.fullmatch(r"(.+?)M(\d)(A?)", code)
    return f"{m[1]} {_ROMAN[int(m[2])]}{m[3]}" if m else code


#: Model code in upper case -> name.
_KNOWN = {k.upper(): v for k, v in IPHONES.items()} | {f"ILCE-{c}": f"Sony α{_generation(c)}" for c in ALPHAS} | {f"DSC-{c}": f"Sony {_generation(c)}" for c in COMPACTS}
_KNOWN |= {c: name for name, codes in PHONES.items() for c in codes.split()} | {"ONEPLUS A6010": "OnePlus 6T", "ONEPLUS A6013": "OnePlus 6T"}
#: Codes that only count as they are written.
_EXACT = {k.upper(): k for k in IPHONES} | {k: k for k in _KNOWN if k.startswith(("ILCE-", "DSC-"))}


def clean(raw: Column) -> Column:
    """A camera's text without NULs, blanks and quotes around; of a list of quoted texts the first that isn't empty."""
    listed = raw.contains('",') | raw.contains(', "')
    parts = F.transform(F.when(listed, F.split(raw, ",")).otherwise(F.array(raw)), lambda p: F.trim(F.regexp_replace(F.trim(F.regexp_replace(p, "\x00", "")), '^"+|"+$', "")))
    return F.get(F.filter(parts, lambda p: F.length(p) > 0), F.lit(0))


def _cased(model: Column) -> Column:
    """Mixed case stays; a code is put in upper case, words in one case are capitalised."""
    upper, lower, spaced = model == F.upper(model), model == F.lower(model), model.contains(" ")
    words = F.array_join(F.transform(F.filter(F.split(model, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")
    return F.when(spaced & ~upper & ~lower, model).when(~spaced, F.upper(model)).otherwise(words)


def friendly_name(make: Column, model: Column, dictionary: Column | None = None) -> Column:
    """One name for maker and model: known codes by their name, makers' own names as they are, else the maker, unless the model begins with it, and the model. Null if both are empty.

    ``dictionary`` is the name of the model in ``device_names``, if there is one.
    """
    m, d = clean(make), clean(model)
    low = F.lower(F.coalesce(m, F.lit("")))
    table = F.create_map(*(F.lit(x) for kv in _KNOWN.items() for x in kv))
    exact = F.create_map(*(F.lit(x) for kv in _EXACT.items() for x in kv))
    code = F.upper(d)
    known = F.when(exact[code].isNull() | (exact[code] == d), table[code])
    begins = lambda *p: F.coalesce(d.rlike("^(" + "|".join(p) + ")"), F.lit(False))
    own = (
        F.when(begins("DSC-"), F.concat(F.lit("Sony "), F.substring(d, 5, 1 << 20)))
        .when(begins("Canon EOS"), d)
        .when(begins("EOS ", "EOS-"), F.concat(F.lit("Canon "), d))
        .when(low.contains("nikon") & begins("Nikon "), d)
        .when(low.contains("nikon") & (begins("Z", "D") | F.lower(d).startswith("coolpix")), F.concat(F.lit("Nikon "), d))
        .when(low.contains("fuji") & begins("X-", "GFX", "FinePix", "Fujifilm"), F.concat(F.lit("Fujifilm "), F.regexp_replace(d, "^(Fujifilm )+", "")))
        .when(begins("Pixel "), F.concat(F.lit("Google "), d))
    )
    both = F.when(d.isNull(), m).when(m.isNull() | F.lower(d).startswith(F.lower(m)), _cased(d)).otherwise(F.concat(m, F.lit(" "), _cased(d)))
    return F.coalesce(known, own, *([] if dictionary is None else [dictionary]), both)


def device_names(rows: DataFrame) -> DataFrame:
    """(code, name) of a list of devices (retail_branding, marketing_name, device, model): the brand is left out where the name begins with it; codes are in upper case, the last row of a code counts once."""
    b, n, c = (F.trim(F.coalesce(x, F.lit(""))) for x in ("retail_branding", "marketing_name", "model"))
    name = F.when((b == "") | F.lower(n).startswith(F.lower(b)), n).otherwise(F.concat(b, F.lit(" "), n))
    return rows.where((c != "") & (n != "")).select(F.upper(c).alias("code"), name.alias("name")).groupBy("code").agg(F.max("name").alias("name"))
