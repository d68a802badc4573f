"""Operations of a training-data pipeline: tokenizing, filtering, joining, searching and sharding of documents."""
