"""Declared table schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind], True))
    return T.StructType(fields)


_KINDS = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "timestamp": T.TimestampType(),
    "params": T.MapType(T.StringType(), T.StringType()),
    "metrics": T.MapType(T.StringType(), T.DoubleType()),
}

RAW_LISTINGS = _struct(
    "preco string,rua string,endereco string,quartos double,banheiros double,"
    "area_m2 double,link string,cidade string,estado string,data_coleta string"
)

GEOCODE_CACHE = _struct("endereco_geo string,lat double,lon double")
GEOCODE_ALT = _struct("endereco_alt string,lat_alt double,lon_alt double")

POI_RESPONSE = T.StructType(
    [
        T.StructField("version", T.DoubleType()),
        T.StructField("generator", T.StringType()),
        T.StructField(
            "osm3s",
            T.StructType(
                [
                    T.StructField("timestamp_osm_base", T.StringType()),
                    T.StructField("copyright", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "elements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("id", T.LongType()),
                        T.StructField("lat", T.DoubleType()),
                        T.StructField("lon", T.DoubleType()),
                        T.StructField("nodes", T.ArrayType(T.LongType())),
                        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

PREDICTIONS = _struct(
    "id string,area_m2 double,bairro string,banheiros int,quartos int,vagas_garagem int,"
    "score_escola_privada double,score_escola_publica double,score_farmacia double,"
    "score_hospitais double,score_mercado double,score_parque double,score_seguranca double,"
    "preco_predito double,modelo string,versao_modelo string,cidade string,created_at timestamp"
)

RUNS = _struct(
    "run_id string,experiment string,run_name string,start_time timestamp,end_time timestamp,"
    "params params,metrics metrics,model_path string"
)
REGISTRATIONS = _struct("name string,run_id string,created_at timestamp,source string")
PAGES = _struct("page_id long,url string,html string")
