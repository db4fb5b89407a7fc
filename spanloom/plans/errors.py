"""What can be wrong with a request; `status` is the usual code of each kind."""


class EngineError(ValueError):
    status = 500


class InvalidRequest(EngineError):
    status = 400


class NotFound(EngineError):
    status = 404


class VersionConflict(EngineError):
    status = 409


class Unprocessable(EngineError):
    status = 422


class Unavailable(EngineError):
    status = 503
