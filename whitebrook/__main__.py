from whitebrook.plans.pipeline import main

main()
