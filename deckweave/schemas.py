"""Declared schemas. Field names are part of the data format and are fixed values."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _texts(*names: str) -> T.StructType:
    return _record(**{name: T.StringType() for name in names})


PRICE = _record(
    low=T.DoubleType(),
    mid=T.DoubleType(),
    high=T.DoubleType(),
    market=T.DoubleType(),
    directLow=T.DoubleType(),
)

SET = _record(
    id=T.StringType(),
    name=T.StringType(),
    series=T.StringType(),
    printedTotal=T.IntegerType(),
    total=T.IntegerType(),
    legalities=_texts("unlimited"),
    ptcgoCode=T.StringType(),
    releaseDate=T.StringType(),
    updatedAt=T.StringType(),
    images=_texts("symbol", "logo"),
)

ATTACK = _record(
    name=T.StringType(),
    cost=STRINGS,
    convertedEnergyCost=T.IntegerType(),
    damage=T.StringType(),
    text=T.StringType(),
)

# Price variants form an open key set, so they are a map and not a struct.
CARD = _record(
    id=T.StringType(),
    name=T.StringType(),
    supertype=T.StringType(),
    subtypes=STRINGS,
    level=T.StringType(),
    hp=T.StringType(),
    types=STRINGS,
    evolvesFrom=T.StringType(),
    abilities=T.ArrayType(_texts("name", "text", "type")),
    attacks=T.ArrayType(ATTACK),
    weaknesses=T.ArrayType(_texts("type", "value")),
    retreatCost=STRINGS,
    convertedRetreatCost=T.IntegerType(),
    set=SET,
    number=T.StringType(),
    artist=T.StringType(),
    rarity=T.StringType(),
    flavorText=T.StringType(),
    nationalPokedexNumbers=T.ArrayType(T.IntegerType()),
    legalities=_texts("unlimited"),
    regulationMark=T.StringType(),
    images=_texts("small", "large"),
    tcgplayer=_record(
        url=T.StringType(),
        updatedAt=T.StringType(),
        prices=T.MapType(T.StringType(), PRICE),
    ),
    cardmarket=_record(
        url=T.StringType(),
        updatedAt=T.StringType(),
        prices=T.MapType(T.StringType(), T.DoubleType()),
    ),
)

ENVELOPE = _record(
    data=T.ArrayType(CARD),
    page=T.IntegerType(),
    pageSize=T.IntegerType(),
    count=T.IntegerType(),
    totalCount=T.IntegerType(),
)

# Every market field is read as text and cast after cleaning: the pages mix numbers and
# strings for the same field.
MARKET_ROW = _texts(
    "sSigla",
    "id",
    "sN",
    "nEN",
    "nPT",
    "p1a",
    "p1b",
    "p1c",
    "iR",
    "sP",
    "dt",
    "ed_sNome",
    "iRaridade",
    "raridade",
    "varianciaSemFormat",
    "sNomeIngles",
    "sNomePortugues",
)

CAPTURED_PAGE = _record(url=T.StringType(), status=T.IntegerType(), html=T.StringType())

ATTEMPT = _record(
    key=T.StringType(), attempt=T.IntegerType(), status=T.IntegerType(), error=T.StringType()
)

# An attempt of a request that wants JSON, with what the answer says it is.
TYPED_ATTEMPT = T.StructType([*ATTEMPT.fields, T.StructField("content_type", T.StringType())])

IMAGE = _record(id=T.StringType(), content=T.BinaryType())
