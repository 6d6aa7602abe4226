"""Where rows come from: the catalog of entities and file readers."""
