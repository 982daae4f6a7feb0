"""What can go wrong with a query, an index or its files."""


class LumenlexError(ValueError):
    """Base of all errors here."""


class QueryError(LumenlexError):
    pass


class ParseError(QueryError):
    """The query text is empty or malformed, or there is no field to search."""


class UnknownField(QueryError):
    def __init__(self, field: object):
        super().__init__(f"unknown field {field!r}")
        self.field = field


class MaxDepthExceeded(QueryError):
    def __init__(self, max_depth: int, actual_depth: int):
        super().__init__(f"query depth {actual_depth} is over {max_depth}")
        self.max_depth, self.actual_depth = max_depth, actual_depth


class MaxNodesExceeded(QueryError):
    def __init__(self, max_nodes: int, actual_nodes: int):
        super().__init__(f"query has {actual_nodes} nodes, over {max_nodes}")
        self.max_nodes, self.actual_nodes = max_nodes, actual_nodes


class InvalidFieldWeight(QueryError):
    def __init__(self, field: int, weight: float):
        super().__init__(f"weight {weight} of field {field} is not finite and non-negative")
        self.field, self.weight = field, weight


class IndexError_(LumenlexError):
    """Base of errors of building, opening or searching an index."""


class DuplicateDocument(IndexError_):
    def __init__(self, doc_id: object):
        super().__init__(f"document {doc_id} is there more than once")
        self.doc_id = doc_id


class MissingAnalyzer(IndexError_):
    def __init__(self, field_id: int):
        super().__init__(f"field {field_id} has no analyzer")
        self.field_id = field_id


class MissingScorer(IndexError_):
    """A collector asks for scores, but there is no scorer."""


class MissingFilter(IndexError_):
    def __init__(self, slot: object):
        super().__init__(f"no filter is given for slot {slot!r}")
        self.slot = slot


class UnsupportedFilterPredicate(IndexError_):
    """Structured predicates are not evaluated unless that is asked for."""


class StoredIndexError(IndexError_):
    """A stored index lacks a table, or its tables do not agree."""
