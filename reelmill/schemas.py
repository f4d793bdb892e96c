"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


PERSON = "id int, credit_id string, name string, original_name string, gender int, known_for_department string, popularity double, profile_path string"

#: The same within a struct, where names and types are parted by a colon.
_IN_STRUCT = ", ".join(f"{name}: {kind}" for name, kind in (c.split() for c in PERSON.split(", ")))

# Field names of the document source, the ratings file and the mart.
PAYLOAD_DDL = f"""
id int, imdb_id string, title string, original_title string, original_language string, overview string, tagline string, status string,
release_date string, runtime int, budget bigint, revenue bigint, popularity double, vote_average double, vote_count int, adult boolean,
homepage string, poster_path string, backdrop_path string,
belongs_to_collection struct<id: int, name: string, poster_path: string, backdrop_path: string>,
genres array<struct<id: int, name: string>>,
production_companies array<struct<id: int, name: string, origin_country: string, logo_path: string>>,
production_countries array<struct<iso_3166_1: string, name: string>>,
spoken_languages array<struct<iso_639_1: string, name: string, english_name: string>>,
credits struct<cast: array<struct<{_IN_STRUCT}, character: string, order: int>>,
  crew: array<struct<{_IN_STRUCT}, department: string, job: string>>>
"""

RATINGS_DDL = "tconst string, averageRating string, numVotes string"
TITLES_DDL = "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult string, startYear string, endYear string, runtimeMinutes string, genres string"

#: The mart: table -> (primary key, columns). References first, links last; loads go in this order.
MART: dict[str, tuple[tuple[str, ...], str]] = {
    "genres": (("id",), "id int, name string"),
    "collections": (("id",), "id int, name string, poster_path string, backdrop_path string"),
    "production_companies": (("id",), "id int, name string, origin_country string, logo_path string"),
    "countries": (("iso_3166_1",), "iso_3166_1 string, name string"),
    "languages": (("iso_639_1",), "iso_639_1 string, name string, english_name string"),
    "people": (("id",), "id int, name string, original_name string, gender smallint, known_for_department string, popularity decimal(10,3), profile_path string"),
    "movies": (
        ("id",),
        "id int, imdb_id string, title string, original_title string, original_language string, overview string, tagline string, status string, release_date date, runtime int, budget bigint, revenue bigint, "
        "popularity decimal(10,3), vote_average decimal(4,2), vote_count int, adult boolean, homepage string, poster_path string, backdrop_path string, collection_id int, imdb_average_rating decimal(3,1), "
        "imdb_num_votes int, imdb_start_year smallint, imdb_runtime_minutes int, imdb_genres array<string>, has_imdb_match boolean, rating_gap decimal(4,2), votes_ratio decimal(10,4), source_fetched_at timestamp, "
        "ingest_date date, loaded_at timestamp",
    ),
    "movie_genres": (("movie_id", "genre_id"), "movie_id int, genre_id int"),
    "movie_production_companies": (("movie_id", "company_id"), "movie_id int, company_id int"),
    "movie_production_countries": (("movie_id", "country_id"), "movie_id int, country_id string"),
    "movie_spoken_languages": (("movie_id", "language_id"), "movie_id int, language_id string"),
    "movie_cast": (("credit_id",), "credit_id string, movie_id int, person_id int, character string, cast_order int"),
    "movie_crew": (("credit_id",), "credit_id string, movie_id int, person_id int, department string, job string"),
}

#: Foreign keys: (table, column, parent, its key).
FOREIGN_KEYS = [
    ("movies", "collection_id", "collections", "id"),
    ("movie_genres", "movie_id", "movies", "id"),
    ("movie_genres", "genre_id", "genres", "id"),
    ("movie_production_companies", "movie_id", "movies", "id"),
    ("movie_production_companies", "company_id", "production_companies", "id"),
    ("movie_production_countries", "movie_id", "movies", "id"),
    ("movie_production_countries", "country_id", "countries", "iso_3166_1"),
    ("movie_spoken_languages", "movie_id", "movies", "id"),
    ("movie_spoken_languages", "language_id", "languages", "iso_639_1"),
    ("movie_cast", "movie_id", "movies", "id"),
    ("movie_cast", "person_id", "people", "id"),
    ("movie_crew", "movie_id", "movies", "id"),
    ("movie_crew", "person_id", "people", "id"),
]

NOT_NULL = {
    "genres": ["name"], "collections": ["name"], "production_companies": ["name"], "countries": ["name"], "people": ["name"],
    "movies": ["title", "adult", "has_imdb_match", "loaded_at"], "movie_cast": ["movie_id", "person_id"], "movie_crew": ["movie_id", "person_id"],
}


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(ddl.split()))


def payload() -> T.StructType:
    return struct_type(PAYLOAD_DDL)


def envelope() -> T.StructType:
    return T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("endpoint", T.StringType()),
            T.StructField("movie_id", T.LongType()),
            T.StructField("fetched_at", T.StringType()),
            T.StructField("schema_version", T.IntegerType()),
            T.StructField("payload", payload()),
        ]
    )
