"""Where signals come from and where results go."""
