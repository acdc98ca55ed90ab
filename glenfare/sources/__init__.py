from glenfare.sources.schema import (  # noqa: F401
    TRIP_SCHEMA, TRIP_COLUMNS, NUMERIC_MEASURES, MissingColumnsError, load, load_trips,
    normalize, read_trips_csv, require_columns, trips_from_lineitem, write_trips_csv)
