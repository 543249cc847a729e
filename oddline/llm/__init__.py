"""Operations of a training-data pipeline: language models, sharding, dedup, packing, archives."""
