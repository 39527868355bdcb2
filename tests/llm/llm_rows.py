def rows_by_id(frame, key="doc_id"):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: (r[key] is None, r[key] or 0))
