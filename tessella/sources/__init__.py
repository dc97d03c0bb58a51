"""Where rows come from: seeds as JSON, and models read off stored tables."""
