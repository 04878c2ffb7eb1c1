"""Table schemas (column names are a fixed data contract) and the missing-value rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Column names of the localization tables.
CORE = ["x1", "x2", "xMean", "y1", "y2", "yMean", "angleDegrees", "zMicrons", "frame_number", "track_number"]
QUALITY = ["residualRMS", "minLobeSNR", "jointEmitterCount", "lobeSeparationPixels", "amplitude1", "amplitude2",
           "sigma1", "sigma2", "pairCost", "recovered", "zStatus", "separationResidual", "sharedLobe",
           "templateScore", "fieldSeparationOffset", "backgroundLevel", "roiSignal", "lobeSignal1", "lobeSignal2",
           "xPrecisionPx", "yPrecisionPx", "anglePrecisionDeg", "zPrecisionUm"]
OUTPUT = ["trackLength", "xCorrected", "yCorrected", "xStabilized", "yStabilized", "zStabilized"]
INTEGER = {"frame_number", "track_number", "jointEmitterCount", "recovered", "zStatus", "sharedLobe", "trackLength"}

# Why a localization was rejected.
REJECT_REASONS = {1: "transient track", 2: "low quality track", 3: "satellite of a brighter track",
                  4: "removed while recovering", 5: "ghost built from other tracks' lobes"}
REMOVED = 4
MOTION_CODES = {"brownian": 0, "confined": 1, "directed": 2}


# The grammar of recording names.
IMAGE_ENDING = r"(?i)(\.ome)?\.tiff?$"
FIRST_POSITION = "_MMStack_Pos0"
OBJECTIVE_APART = r"(?<![0-9])(4|10|20|40|60|63|100)\s*[xX](?![a-zA-Z0-9])"
OBJECTIVE_ANY = r"(?<![0-9])(4|10|20|40|60|63|100)[xX]"
STAGE_SPEED = r"(?i)(?<![\d.])(\d+(?:\.\d+)?)\s*um/?s"
FRAME_SECONDS = r"(?<![\d.])(\d*\.?\d+)\s*s(?:_|$)"


def _field(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType() if name in INTEGER else T.DoubleType(), True)


LOCALIZATIONS = T.StructType([T.StructField("movie", T.StringType())] + [_field(c) for c in CORE + QUALITY])
DRIFT = T.StructType([T.StructField("movie", T.StringType()), T.StructField("frame_number", T.IntegerType())]
                     + [T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "dz", "dz_raw")])
FRAMES = T.StructType([T.StructField("movie", T.StringType()), T.StructField("frame", T.IntegerType()),
                       T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
                       T.StructField("pixels", T.ArrayType(T.FloatType()))])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in text inputs; Spark sorts NaN last and averages it, so it becomes NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])
