"""What is refused instead of guessed."""


class NonConvertible(ValueError):
    """The construct has no faithful set-based meaning."""


class MissingOrder(ValueError):
    """A positional construct was used without a stated order."""


class MissingKey(ValueError):
    """A keyed construct was used without a key."""


def need_order(order, what: str) -> list:
    if not order:
        raise MissingOrder(f"{what} needs order=")
    return [order] if isinstance(order, str) else list(order)


def need_key(by, what: str) -> list[str]:
    if not by:
        raise MissingKey(f"{what} needs a key")
    return [by] if isinstance(by, str) else list(by)
