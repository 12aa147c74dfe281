"""Declared schemas of the input tables; nothing is inferred from samples."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {
        "date": T.DateType(),
        "double": T.DoubleType(),
        "int": T.IntegerType(),
        "long": T.LongType(),
        "string": T.StringType(),
    }
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in fields])


LINES = _schema(
    "date:date store_id:string sku_gtin:long sku_description:string sales:double quantity:double"
)
# One feed keys its stores by business number instead of store id.
LINES_BY_BUSINESS = _schema(
    "date:date business_gln:string sku_gtin:long sku_description:string sales:double quantity:double"
)
STORES = _schema(
    "id:string gln:string kjedeid:string paraplykjede:string adresse:string postnr:string "
    "poststed:string kommune_id:string oms:double x:double y:double"
)
STORES_WITH_DISTANCE = T.StructType(
    STORES.fields
    + _schema(
        "min_distance_all:double min_distance_other_group:double min_distance_other_chain:double"
    ).fields
)
CELLS = _schema(
    "month:int week:int sku_gtin:long store_id:string kjedeid:string trans:long price:double quantity:double"
)
MODES = _schema("month:int week:int sku_gtin:long store_id:string ppu:double n:long mode:long")
PRODUCTS = _schema(
    "GTIN:long ProductGroupName:string product_group_level_01:string calories:double fat:double sugars:double"
)
CATEGORIES = _schema("sku:long kassalcat:string")
PRODUCT_ATTRIBUTES = _schema(
    "ean:long category_name:string parent_category_name:string food_cat:string"
)
COMMON_SKUS = _schema("sku_gtin:long")
