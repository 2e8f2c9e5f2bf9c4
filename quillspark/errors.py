"""What can go wrong, by kind. Only ``PathError`` and ``QueryError`` are a caller's fault."""


class EngineError(Exception):
    code = -32000


class ConfigError(EngineError):
    pass


class PathError(EngineError):
    pass


class QueryError(EngineError):
    pass


class StoreError(EngineError):
    pass


class SchemaError(StoreError):
    """The store has an older layout and must be rebuilt before it is read."""


class LockError(StoreError):
    pass


class EmbeddingError(EngineError):
    pass


class SyncError(EngineError):
    pass
