"""Table operators: masks, joins, transforms, generation, profiles, metrics and audits."""
