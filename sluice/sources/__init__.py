"""Where rows come from: snapshots, change feeds, table lists."""
