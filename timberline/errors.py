class SpecError(ValueError):
    """A rule, bound or option that cannot be used; raised before any job runs."""


def need(condition: bool, message: str) -> None:
    if not condition:
        raise SpecError(message)
