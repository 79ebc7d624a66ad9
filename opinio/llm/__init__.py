"""Operations of a training-data pipeline: deduplication, filtering, mixing, packing, sharding and token output."""
