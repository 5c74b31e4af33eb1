"""Column functions: text, numbers, time and nested item documents."""
